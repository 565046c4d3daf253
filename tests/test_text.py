import re
import unicodedata

from pyspark.sql import functions as F

from kinweave.functions import text as x


def fold(value):
    return "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")


def normal(value):
    out = fold(value.strip().lower()).replace("-", " ").replace("_", " ")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", out)).strip()


def key(value):
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")


def test_names_against_the_standard_library(spark):
    values = ["Réseaux de Neurones", "NLP (core)", "deep--learning", "", "ﬁn №5 ½", "한국어", "Straße x", " Ünï\tcode ", "北京 x"]
    values += [f"a{chr(c)}b" for c in range(0xA0, 0x250)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", x.normalize(F.col("v")).alias("n"), x.name_key(F.col("v")).alias("k")).collect():
        assert row["n"] == normal(row["v"])
        assert row["k"] == key(row["v"])


def test_generic_terms(spark):
    df = spark.createDataFrame([("Data Analysis",), ("graph data",), ("",), ("Model",)], "v string")
    assert [r[0] for r in df.select(x.is_generic(F.col("v"))).collect()] == [True, False, False, True]


def test_keywords_put_phrases_first(spark):
    df = spark.createDataFrame([("I need a project about Graph neural networks!",), ("of",)], "q string")
    first, second = [r[0] for r in df.select(x.query_keywords(F.col("q"))).collect()]
    assert first == ["graph neural networks", "graph neural", "neural networks", "graph", "neural", "networks"]
    assert second == []


def test_dates_years_languages_labels(spark):
    df = spark.createDataFrame([
        ("2026-01-03", "en", "2026", "A/B [x]"), ("2026-01", "xx", "2026-05", "C"), ("2026-02-30", "pt-BR", "abcd", "D ]"),
        ("2026Z", "eng", "12", ""),
    ], "d string, l string, y string, t string")
    out = df.select(x.is_valid_date(F.col("d")), x.is_valid_language(F.col("l")), x.parse_year(F.col("y")), x.clean_domain_label(F.col("t"))).collect()
    assert [r[0] for r in out] == [True, False, False, True]
    assert [r[1] for r in out] == [True, False, True, False]
    assert [r[2] for r in out] == [2026, 2026, None, 12]
    assert [r[3] for r in out] == ["B", "C", "D ]", ""]


def test_citations_and_display_names(spark):
    df = spark.createDataFrame([("see [hal-1], [a.b] and [hal-1] [no space]", "ada-o'neil-2x"), ("none", "unknown_X y")], "t string, p string")
    out = df.select(x.cited_ids(F.col("t")), x.display_name(F.col("p"))).collect()
    assert out[0][0] == ["hal-1", "a.b"] and out[1][0] == []
    assert out[0][1] == "ada-o'neil-2x".replace("-", " ").title() and out[1][1] == "unknown_X y"


def test_strip_and_squeeze_know_every_space(spark):
    """The spelled-out spaces are those of the Unicode property and the four separators, and no other character of the plane."""
    spaces = {c for c in map(chr, range(0x110000)) if c.isspace()}
    assert set(x.SPACES) == spaces and not any(unicodedata.category(c)[0] in "LN" for c in x.SPACES)
    points = [p for p in range(1, 0x3100) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, f"{chr(p)}a{chr(p)}{chr(p)}b{chr(p)}\n") for p in points], "p int, t string")
    out = rows.select("p", x.strip(F.col("t")).alias("s"), x.squeeze(F.col("t")).alias("q")).collect()
    for r in out:
        c = chr(r["p"])
        assert r["s"] == (f"a{c}{c}b" if c in spaces else f"{c}a{c}{c}b{c}"), r
        assert r["q"] == (" a b " if c in spaces else f"{c}a{c}{c}b{c} "), r


def test_conferences_parse_a_record_once(spark):
    """No filter stands below the parsing of a record, where it would repeat it."""
    from kinweave.operators.canonical import with_project_id
    from kinweave.operators.publications import extract_conferences
    from kinweave.sources.records import parse_lines

    lines = spark.createDataFrame([(i, t) for i, t in enumerate(['{"conferenceTitle_s": ["C", "x"]}', '{"conferenceTitle_s": ""}', "{}"])], "doc_ord long, value string")
    rows = extract_conferences(with_project_id(parse_lines(lines)))
    assert [r["conferenceId"] for r in rows.collect()] == ["c"]
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("parseJson") == 1
