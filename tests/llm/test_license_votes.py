from loomwork.llm import license_scan


def test_spans_that_verify_have_votes_enough(spark):
    isc = dict((label, t) for t, label in license_scan.TEMPLATES)["isc"].split()
    for i in (4, 8, 12, 16):
        isc[i] = f"other{i}"
    rows = [
        (1, "licensed under a kreative commons attribution sharealike"),
        (2, "licensed under a kreative commons contribution sharealike"),
        (3, " ".join(isc)),
    ]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("cc-by-sa", ""), 2: ("", ""), 3: ("isc", "")}
