"""WARC records of a page id that occurs with different payloads."""

import hashlib

from tidemark.llm.warc import warc_round_trip


def test_each_payload_is_decided_by_itself(spark):
    old, new = "o" * 150, "n" * 200
    rows = [(1, "a", old), (2, "b", old), (2, "b", new), (3, "c", new)]
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    name = {t: hashlib.sha256(t.encode()).hexdigest() for t in (old, new)}
    assert got == sorted([(1, name[old], "response", None, True), (2, name[old], "revisit", 1, True), (2, name[new], "response", None, True), (3, name[new], "revisit", 2, True)], key=lambda r: r[:2])
