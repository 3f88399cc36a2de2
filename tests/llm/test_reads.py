"""How often an operator reads the texts again."""

from souq.llm import jaccard_join


def test_candidates_of_small_groups_read_their_texts_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:50 + i])) for i in range(4)] + [(9, "other words stand here for once")]
    asked = []
    whole_sets = jaccard_join._Join.whole_sets
    monkeypatch.setattr(jaccard_join._Join, "whole_sets",
                        lambda self, ids, name: asked.append(name) or whole_sets(self, ids, name))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in got} == {
        0: (46, 0), 1: (47, 0), 2: (48, 0), 3: (49, 0), 9: (2, 9)}
    assert asked == ["tried"]
