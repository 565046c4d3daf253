from kinweave.operators.canonical import canonical_table, canonical_tables

SHIFTED = {
    "halId_s": "h1", "authFullName_s": ["Sébastien Acket", "Luminita Duma", "Yannick Rossez", "Xu Yi"],
    "authIdHal_s": ["luminita-duma", "yannick-rossez", 0, 0], "authIdPerson_i": [42, 0, 0, 7],
}


def ids(records, doc):
    from kinweave.operators.authors import extract_authors
    from kinweave.operators.canonical import with_project_id

    return [r["halId"] for r in extract_authors(with_project_id(records(doc))).orderBy("pos").collect()]


def test_shifted_identifiers_are_repaired(records):
    assert ids(records, SHIFTED) == ["person_42", "luminita-duma", "yannick-rossez", "person_7"]


def test_unmatched_identifiers_of_a_shifted_record_are_dropped(records):
    doc = {**SHIFTED, "authIdHal_s": ["luminita-duma", "yannick-rossez", "someone-else", 0], "authIdPerson_i": []}
    assert ids(records, doc) == ["unknown_Sébastien Acket", "luminita-duma", "yannick-rossez", "unknown_Xu Yi"]


def test_without_a_shift_positions_stand(records):
    doc = {"authFullName_s": ["Ada Byron", "Bo Li"], "authIdHal_s": ["ada-byron", "0"], "authIdPerson_i": [42, "0"]}
    assert ids(records, doc) == ["ada-byron", "unknown_Bo Li"]
    assert ids(records, {"authFullName_s": ["Ada Byron", "Ada Byron"], "authIdHal_s": [0, "ada-byron"]}) == ["unknown_Ada Byron", "ada-byron"]


def test_scalars_and_gaps(records):
    assert ids(records, {"authFullName_s": "Solo", "authIdHal_s": "solo-x"}) == ["solo-x"]
    assert ids(records, {}) == []
    row = canonical_table(records({"docid": 5, "title_s": None, "docType_s": ["ART"], "language_s": "en"}), "projects").first()
    assert (row["halId"], row["title"], row["documentType"], row["language"], row["publicationYear"]) == ("5", "Untitled", "['ART']", ["en"], None)


def test_organizations_merge_and_ignore_short_arrays(records):
    doc = {
        "halId_s": "h", "structId_i": [2175, 2175, 93027], "structName_s": ["", "Lab", "Uni"], "structCode_s": ["x"],
        "structRorIdExt_s": ["https://ror.org/abc/", "", ""],
        "structIsChildOf_fs": ["2175_laboratory_JoinSep_93027_FacetSep_Uni", "2175_laboratory_JoinSep_93027_FacetSep_Uni", "bad"],
    }
    tables = canonical_tables(records(doc))
    rows = {r["halId"]: r for r in tables["organizations"].collect()}
    assert rows[2175]["name"] == "Lab" and rows[2175]["ror"] == "abc" and rows[2175]["code"] is None
    assert [tuple(r) for r in tables["organization_relationships"].collect()] == [(2175, 93027, "PART_OF")]


def test_domains_labels_and_hierarchy(records):
    doc = {
        "halId_s": "h", "primaryDomain_s": "info.info-db", "domainAllCode_s": ["spi", "info", "spi"],
        "en_domainAllCodeLabel_fs": ["info.info-db_FacetSep_Computer Science [cs]/Databases [cs.DB]", "spi:Eng"],
        "fr_domainAllCodeLabel_fs": ["a", "b", "c"], "level0_domain_s": ["spi", "info"], "level1_domain_s": ["info.info-db"],
    }
    tables = canonical_tables(records(doc))
    assert {tuple(r)[:3] for r in tables["research_domains"].collect()} == {("info.info-db", "Databases", "a"), ("spi", "Eng", "b"), ("info", "c", "c")}
    assert {tuple(r) for r in tables["project_research_domains"].collect()} == {("h", "info.info-db", True), ("h", "spi", False), ("h", "info", False)}
    assert [tuple(r) for r in tables["research_domain_hierarchy"].collect()] == [("info.info-db", "info")]


def test_conference_key_leaves_out_the_end_date(records):
    doc = {"halId_s": "h", "conferenceTitle_s": ["Test  Conf", "x"], "conferenceEndDate_s": "2026-02-01", "city_s": "Compiègne"}
    row = canonical_table(records(doc, {"halId_s": "i"}), "conferences").collect()
    assert [r["conferenceId"] for r in row] == ["test_conf_compiègne"]


def test_first_record_of_a_key_wins(records):
    rows = canonical_table(records({"halId_s": "h", "title_s": "first"}, {"halId_s": "h", "title_s": "second"}), "projects").collect()
    assert [r["title"] for r in rows] == ["first"]


def test_author_links_are_those_of_the_whole_authors(records):
    from kinweave.operators import authors as a
    from kinweave.operators.canonical import with_project_id

    rows = with_project_id(records(
        {"halId_s": "h1", "authFullName_s": ["Ada B", "Cy D", ""], "authIdHal_s": ["cy-d", "ada-b"], "authIdPerson_i": [0, 5, 7]},
        {"halId_s": "h2", "authFullName_s": "Solo X", "authIdHal_s": "solo-x"}, {"halId_s": "h3"}, {"authFullName_s": ["No Id", None], "authIdHal_s": ["0"]},
    ))
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    links = plain(a.extract_author_links(rows))
    assert links == plain(a.extract_authors(rows).select("projectHalId", "halId")) and len(links) == 6


def test_tables_read_opened_records(records):
    """A record is parsed once for all eleven tables, which hold what each gives by itself."""
    docs = records({**SHIFTED, "structId_i": [1], "structIsChildOf_fs": "1_Lab_JoinSep_2_FacetSep_x", "primaryDomain_s": "a.b",
                    "level0_domain_s": "a", "level1_domain_s": "a.b", "conferenceTitle_s": "Conf"}, {"docid": 5, "authFullName_s": [" Ada  Byron King"]}, "broken")
    tables = canonical_tables(docs)
    for name, rows in tables.items():
        assert "variant_get" not in rows._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(repr, rows.collect())) == sorted(map(repr, canonical_table(docs, name).collect()))
    assert all(rows.count() for rows in tables.values())
    assert {(r["firstName"], r["lastName"]) for r in tables["authors"].where("halId = 'unknown_ Ada  Byron King'").collect()} == {("Ada", "Byron King")}
