"""Archives written, read back, and broken."""

import pytest


def test_warc(tmp_path, spark):
    from latticework.llm import warc

    html = "<html>" + "text " * 50
    pages = spark.createDataFrame([(1, "http://a/ü", html, 1), (2, None, html, 2), (3, "u", "short", 3), (4, "u", "short", 4), (5, "u", None, 5), (None, "u", html, 6)], "page_id long, url string, html string, digest int")
    m = warc.archive(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"] or b"").decode()) for r in warc.read_archives(m).collect()}
    n = len(html)
    assert got == {1: ("response", None, n, html), 2: ("revisit", 1, n, ""), 3: ("response", None, 5, "short"), 4: ("response", None, 5, "short"), 5: ("response", None, 0, ""), None: ("revisit", 1, n, "")}
    assert warc.read_archives(warc.archive(pages.limit(0), f"file://{tmp_path}/e")).count() == 0
    path = m.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-3])
    with pytest.raises(Exception, match="cut off|WarcError"):
        warc.read_archives(m).collect()
    good = {"WARC-Record-ID": "x", "WARC-Date": "2024-05-06T07:08:09Z"}
    assert warc.parse(warc.record("response", good, b"abc"))[1] == b"abc"
    whole = warc.record("response", good, b"abc")
    for bad in (
        b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", whole[:-1], b"HTTP/1.1\r\n\r\n", warc.record("response", {"WARC-Record-ID": "x"}, b"abc"),
        warc.record("response", good | {"WARC-Date": "yesterday"}, b"abc"), whole.replace(b"WARC-Date", b"WARC-Type"), whole.replace(b"Length: 3", b"Length: 2"),
    ):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def rewritten(warc, path, change):
    """The archive's records with header fields changed, in frames without a dictionary."""
    import zstandard as z

    with open(path, "rb") as f:
        records = list(warc.read_records(f))
    out = warc.head(b"")
    for fields, block in records:
        kind = fields.pop("warc-type")
        fields.pop("content-length")
        out += z.compress(warc.record(kind, change(kind, fields), block))
    with open(path, "wb") as f:
        f.write(out)


@pytest.mark.parametrize("field", ["x-refers-to-page-id", "warc-payload-digest", "x-payload-bytes"])
def test_revisits_are_held_against_responses(tmp_path, spark, field):
    from latticework.llm import warc

    html = "<p>" + "words " * 40
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (2, "u", html), (3, "u", "x" * 500)], "page_id long, url string, html string").coalesce(1)
    m = warc.archive(pages, f"file://{tmp_path}/w").coalesce(1)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_index(m).collect()) == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None)]
    to = {"x-refers-to-page-id": "3", "warc-payload-digest": "sha256:" + "0" * 64, "x-payload-bytes": "7"}[field]
    for r in m.collect():
        rewritten(warc, r["path"].removeprefix("file://"), lambda kind, h: h | {field: to} if kind == "revisit" else h)
    with pytest.raises(warc.WarcError, match="no response of its digest"):
        warc.read_index(m)


def test_long_payload_and_repeated_ids(tmp_path, spark):
    from latticework.llm import warc

    long = "é" * 3_000_000
    pages = spark.createDataFrame([(5, "u\r\nX: y", long, 1), (5, None, long, 2), (4, "ü", long + "x", 3)], "page_id long, url string, html string, `payload.x` int")
    got = sorted((r["page_id"], r["record_type"], r["payload_bytes"], len(r["payload"] or b"")) for r in warc.read_archives(warc.archive(pages, f"file://{tmp_path}/w")).collect())
    assert got == [(4, "response", 6_000_001, 6_000_001), (5, "response", 6_000_000, 6_000_000), (5, "response", 6_000_000, 6_000_000)]
