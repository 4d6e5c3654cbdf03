"""The pipeline's near-duplicate stage links what ``op2`` links, besides texts of similar shingles."""

from .conftest import frame


def test_stage_joins_near_codes(spark, tmp_path):
    import corpus_pipeline
    from lectern.llm.near_copies import alike, shingles
    from lectern.llm.simhash_gray import fingerprint

    # over half of the three-word shingles of both are the same one, so their codes are equal; no other text is like them
    one, two = b"a a a a a a a b c", b"a a a a a a a d e"
    assert fingerprint(one) == fingerprint(two) and not alike(shingles(one), shingles(two))
    rows = [(3, one.decode(), "en", "a"), (2, two.decode(), "en", "a"), (1, "quite another text of some words", "en", "a"), (None, two.decode(), "en", "a")]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
