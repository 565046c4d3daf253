"""Secret scans with corpus-wide ownership frequency, on DataFrame functions alone.

Base spans are the matches of three patterns. Further candidates are long tokens that mix digits, upper
and lower case letters. Every candidate's value is hashed, and for each hash the distinct repositories
and owners that hold it are counted over the whole corpus, copies of a text included. The verdict takes copies of a
text as one: it counts for its first owner, that of the first repository, by name, whose owner is known. A value of
more than ``MOST_OWNERS`` such owners is a widely copied example; one that stays with its owner looks live, in however
many of the owner's repositories it is.
Token candidates become spans where they look live; base spans stay whatever the count, and their verdict
is told apart from it.

Counts are partial in each task before any shuffle; only hashes and keys are moved, texts are not.

Defined cases: null or empty text has no spans; a null repository or owner is not counted as one; repeated
rows count once; matches of a pattern that fall short are dropped, but take up their place in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.columns import match_spans
from kinweave.session import stage

#: Fixed patterns. The bounded forms of access keys and hexadecimal runs match what the open forms do after short ones are dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
LEAST_VALUE = 12
MOST_OWNERS = 1
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _spans(text: Column) -> Column:
    """Sorted (start, rank of the kind, end, hash of the value) of base spans and token candidates."""
    def of(rank: int, pattern: str, group: int = 0, keep=None) -> Column:
        found = match_spans(text, pattern, group)
        found = F.filter(found, keep) if keep is not None else found
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.sha2(x["g0"], 256).alias("value")))

    mixed = lambda x: (x["g0"].rlike("[0-9]") & x["g0"].rlike("[A-Z]") & x["g0"].rlike("[a-z]")
                       & ~x["g0"].rlike(HEX) & ~x["g0"].rlike(ACCESS))
    return F.array_sort(F.concat(
        of(0, ASSIGN, 2, lambda x: F.char_length(x["g0"]) >= LEAST_VALUE), of(1, ACCESS), of(2, HEX), of(3, TOKEN, 0, mixed)).cast(_SPANS))


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text; spans and verdicts are the same wherever the text is."""
    return [F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_a"), F.coalesce(F.xxhash64(F.lit(1), text), F.lit(0)).alias("text_b")]


def scan(docs: DataFrame, text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(text_a, text_b, repository, owner, found, *keep) of every row; ``found`` holds all candidate spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*text_keys(F.col(text_col)), F.col(repository_col).cast("string").alias("repository"),
                       F.col(owner_col).cast("string").alias("owner"), _spans(text).alias("found"), *[F.col(c) for c in keep])


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n_text_owners, live) of every candidate value in the corpus: all that hold it, and
    the owners of its distinct texts, which decide."""
    own = F.struct(F.col("owner").isNull().alias("unowned"), F.col("repository").isNull().alias("unnamed"), "repository", "owner")
    texts = scanned.select("text_a", "text_b", "repository", "owner", own.alias("own"), F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("value"))
    held = texts.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    firsts = texts.groupBy("text_a", "text_b", "value").agg(F.min("own").alias("own")).select("value", F.col("own.owner").alias("owner"))
    counts = firsts.groupBy("value").agg(F.count_distinct("owner").alias("n_text_owners"))
    return held.join(counts, "value").select("value", "n_owners", "n_repositories", "n_text_owners", (F.col("n_text_owners") <= MOST_OWNERS).alias("live"))


def live_values(scanned: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(text_a, text_b, live): the values of each text that look live."""
    texts = scanned.where(F.size("found") > 0).select(
        "text_a", "text_b", F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("value")).distinct()
    return texts.join(verdicts.where("live"), "value").groupBy("text_a", "text_b").agg(F.collect_set("value").alias("live"))


def judged(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``found`` reduced to spans proper, and ``live``, the values among them that look live."""
    live = live_values(scanned, ownership(scanned))
    joined = scanned.join(live, ["text_a", "text_b"], "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    return joined.withColumn("found", F.filter("found", lambda x: (x["rank"] < 3) | F.array_contains("live", x["value"])))


def _listed(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of base spans, all spans, and how many look live."""
    found = judged(stage(scan(docs, keep=("doc_id",)), "scanned"))
    base = F.filter("found", lambda x: x["rank"] < 3)
    count = lambda rank: F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: F.array_contains("live", x["value"]))).cast("long").alias("n_live"))


def redact_live(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with spans whose value looks live replaced by ``mask``; all rows and columns stay, ``length_col`` follows the text."""
    # Names that no column of the documents has.
    taken = {c.lower() for c in docs.columns}
    new, spans, key_a, key_b, hit_a, hit_b = [next(n for n in (f"{x}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken)
                                              for x in ("_new", "_spans", "_text_a", "_text_b", "_hit_a", "_hit_b")]
    found = judged(stage(scan(docs, text_col), "scanned")).select(
        "text_a", "text_b", F.filter("found", lambda x: F.array_contains("live", x["value"])).alias("found")).where(F.size("found") > 0)
    hits = stage(found.dropDuplicates(["text_a", "text_b"]), "hits")
    # Overlapping spans become one, then the text is put together from what lies between.
    united = F.aggregate("found", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda t, x: F.when(
        (F.size(t) > 0) & (F.element_at(t, -1)["end"] >= x["start"]),
        F.concat(F.slice(t, F.lit(1), F.size(t) - 1), F.array(F.struct(F.element_at(t, -1)["start"].alias("start"), F.greatest(F.element_at(t, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(t, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    text = F.col(f"`{text_col}`")
    masked = F.aggregate(F.reverse(spans), text, lambda t, x: F.overlay(t, F.lit(mask), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    hits = hits.select(F.col("text_a").alias(hit_a), F.col("text_b").alias(hit_b), united.alias(spans))
    # Only rows with any candidate can change; the others are not moved.
    candidate = F.coalesce(text.rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{TOKEN}"), F.lit(False))
    a, b = text_keys(text)
    changed = docs.where(candidate).withColumns({key_a: a, key_b: b}).join(hits, (F.col(key_a) == F.col(hit_a)) & (F.col(key_b) == F.col(hit_b)), "left")
    changed = changed.withColumn(new, F.when(F.col(spans).isNull(), text).otherwise(masked))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == length_col:
            columns.append(F.when(F.col(spans).isNull(), F.col(f"`{c}`")).otherwise(F.char_length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return docs.where(~candidate).unionByName(changed.select(*columns))
