"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline

VOCABULARY = ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(2 + i % 7)) + str(i % 3) for i in range(900)]


def prose(n, rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_stages(spark, docs, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng.randint(30, 120), rng), "en", f"s{i % 4}") for i in range(120)]
    twin, passage, item = prose(100, rng), prose(120, rng), prose(25, rng)
    rows += [(200, twin, "en", "s0"), (201, twin.replace(" ", "  "), "en", "s0"), (202, twin + " more", "en", "s1")]
    rows += [(300 + i, f"{prose(40, rng)} {passage} {prose(40, rng)}", "en", "s2") for i in range(3)]
    rows += [(400, f"{prose(30, rng)} {item} {prose(30, rng)}", "en", "s3"), (500, "12 34 !!", "en", "s0"), (501, None, "en", "s0")]
    docs(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = docs(rows, extra=False)
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = current.columns
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert current.columns == before
        kept[name] = {r["doc_id"]: r for r in current.collect()}
    clean = set(range(120))
    assert set(kept["language"]) == {r[0] for r in rows} - {500, 501}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {201, 202}
    assert set(kept["repeated_passages"]) == set(kept["near_duplicates"])
    for i in (300, 301, 302):
        assert passage not in kept["repeated_passages"][i]["text"] and kept["repeated_passages"][i]["n_chars"] == len(kept["repeated_passages"][i]["text"])
    assert all(kept["repeated_passages"][i]["text"] == kept["language"][i]["text"] for i in clean)
    assert set(kept["repeated_passages"]) - set(kept["benchmark"]) == {400}
    assert set(kept["mixture"]) <= set(kept["benchmark"]) and all(r["copies"] in (1, 2) for r in kept["mixture"].values())
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["copies"]) for r in run} == {(k, r["copies"]) for k, r in kept["mixture"].items()}


def test_passages_against_brute_force(spark, docs):
    from collections import Counter

    from tallyspark.llm import passages

    rng = random.Random(5)
    short = [f"{c}{d}" for c in "abcdefgh" for d in "0123456789éü"]
    passage, fifty, left, right = (" ".join(rng.choice(short) for _ in range(n)) for n in (51, 50, 30, 30))
    texts = [f"{prose(20, rng)} {x} {prose(30, rng)}" for x in (passage, passage.replace(" ", "\n ", 3), fifty, fifty, f"{left} {right}", f"{left} {prose(30, rng)}", f"{prose(30, rng)} {right}")]
    texts += [prose(300, rng), "x y " * 60, None, "", prose(50, rng)]
    texts += [texts[-1], texts[7], passage, f"{prose(9, rng)}\n{' '.join(texts[7].split()[40:120])} {passage}"]
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    expected = []
    for w in words:
        gone = {k for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for k in range(i, i + 51)}
        expected.append([x for i, x in enumerate(w) if i not in gone])
    out = {r["doc_id"]: r for r in passages.strip(docs(list(enumerate(texts)))).collect()}
    assert [(out[i]["text"] or "").split() for i in range(len(texts))] == expected
    assert all(out[i]["n_chars"] == len(out[i]["text"] or "") for i in out)
    assert len(expected[0]) == len(expected[1]) == 50 and expected[2] == words[2] and expected[4] == words[4] and out[9]["text"] is None
    assert passages.strip(docs(list(enumerate(texts))).where("false")).count() == 0


def test_stage_finds_passages_of_51_short_words(spark, docs):
    rng = random.Random(6)
    passage = " ".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(51))
    rows = [(i, f"{prose(40, rng)} {passage} {prose(40, rng)}", "en", "s") for i in range(2)]
    out = corpus_pipeline.repeated_passages(spark, docs(rows, extra=False), "").collect()
    assert len(passage) == 101 and all(passage not in r["text"] and len(r["text"].split()) == 80 for r in out)


def test_stage_goes_by_the_suffix_indexes(spark, docs, monkeypatch):
    from tallyspark.llm import passages, suffix_dedup

    added = []
    monkeypatch.setattr(suffix_dedup.SuffixIndex, "add", lambda self, texts, add=suffix_dedup.SuffixIndex.add: (add(self, texts), added.append([x.size for x in self.levels])))
    rng = random.Random(7)
    passage = " ".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(51))
    rows = [(i, f"{prose(40, rng)} {passage if i % 5 == 0 else prose(51, rng)} {prose(40, rng)}", "en", "s") for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs(rows, extra=False), "").collect()}
    assert len(added) == 3 and all(a >= 2 * b for sizes in added for a, b in zip(sizes[:-2], sizes[1:-1]))
    assert {i for i in out if len(out[i].split()) == 80} == set(range(0, 30, 5))
    again = passages.strip(docs(rows, extra=False)).collect()
    assert {r["doc_id"]: r["text"] for r in again} == out


def test_suffix_query_tells_passages_by_words(spark, docs, tmp_path):
    from tallyspark.llm import queries

    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(51))
    rows = [(i, f"{prose(40, rng)} {passage if i < 2 else prose(51, rng)} {prose(40, rng)}", "en", "s") for i in range(6)] + [(9, None, "en", "s")]
    docs(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op2_suffixes(spark, str(tmp_path)).collect()}
    assert {i: r["passage_bytes"] for i, r in out.items()} == {i: 101 if i < 2 else 0 for i in (*range(6), 9)}
    assert all(r["n_removed"] == 0 for r in out.values())  # shorter than 400 bytes
