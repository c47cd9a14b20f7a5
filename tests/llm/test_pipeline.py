import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from fusewright.llm import mixing, ngram_join, packing, secrets, toxicity  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rows = []
    for i in range(240):
        words = [f"w{(i * 37 + j * j * 11) % 997}" for j in range(20 + i % 50)]
        if i % 4 == 0:
            words.insert(3, "snarfle")
        if i % 7 == 0:
            words[5:5] = ["token", "=", '"' + f"{i:04d}" * 10 + '"']
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    rows += [(300 + i, rows[i][1], "en", "s9", 0) for i in range(1, 40)]
    rows += [(350 + i, rows[i][1] + " and more", "en", "s9", 0) for i in range(1, 40, 2)]  # near copies
    return rows + [(400, None, "en", None, 0), (401, "", "en", "s1", 0), (None, "no id at all here", "en", "s1", 0)]


def one_of_each(rows):
    """By comparing all pairs: of each component the row of the least id."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    first: dict = {}
    for k, r in zip(root, rows):
        if k not in first or (r[0] is None, r[0] or 0) < (first[k] is None, first[k] or 0):
            first[k] = r[0]
    return [r for k, r, s in zip(root, rows, sets) if not s or first[k] == r[0]]


def test_stages_by_brute_force(spark, tmp_path):
    rows = corpus()
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, known)
    kept = [r for r in rows if model.score([r[1] or ""])[0] < 0.5]
    assert len(kept) < len(rows)
    one = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, kept))
    kept = one_of_each(kept)
    two = corpus_pipeline.drop_near_duplicates(spark, one, str(tmp_path))
    assert two.columns == docs.columns and sorted(map(str, map(tuple, two.collect()))) == sorted(map(str, kept))
    grammar = secrets.learn()
    kept = [(r[0], t := None if r[1] is None else secrets.redacted(r[1], grammar), *r[2:4], None if t is None else len(t)) for r in kept]
    three = corpus_pipeline.redact_secrets(spark, two, str(tmp_path))
    assert three.columns == docs.columns and sorted(map(str, map(tuple, three.collect()))) == sorted(map(str, kept))
    assert any("[assign]" in (r[1] or "") for r in kept)
    four = corpus_pipeline.mix_sources(spark, three, str(tmp_path))
    assert four.columns == docs.columns
    got = four.collect()
    whole = {(r[0], r[3]): r[1] for r in kept}
    words = lambda t: len((t or "").split())
    by_source, by_doc = Counter(), defaultdict(list)
    for r in got:
        assert (whole[r.doc_id, r.source] or "").startswith(r.text) and r.n_chars == len(r.text)
        by_source[r.source] += words(r.text)
        by_doc[r.doc_id, r.source].append(words(r.text))
    total = sum(words(t) for t in whole.values())
    assert abs(sum(by_source.values()) - 1.5 * total) < 5
    assert all(sum(v) <= 2 * words(whole[k]) for k, v in by_doc.items())
    five = corpus_pipeline.pack_tokens(spark, four, str(tmp_path)).collect()
    encoder = packing.WordEncoder.of(packing.default_vocabulary())
    want = Counter(len(encoder.whole(r.text)) + 1 for r in got)
    assert Counter(r.doc_tokens for r in five if r.start == 0) == want and sum(r.length for r in five) == sum(k * v for k, v in want.items())
    full = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start + r.length) for r in full if r.start + r.length == r.doc_tokens) == Counter((r.doc_id, r.doc_tokens) for r in five if r.start + r.length == r.doc_tokens)


ODD = "doc_id bigint, text string, source string, toxic_score string, taken string, size string, copy string, doc_id_key string, source_key string, row_id string, row_a string, Row_B string, `a.b` string, component_id string"


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """No n_chars; helper-like columns; null and repeated ids, rows alike in all, near copies of one id."""
    prose = lambda k: " ".join(f"v{(k * 31 + j * j) % 613}" for j in range(40))
    texts = [(i, prose(i)) for i in range(8)]
    texts += [(1, prose(1)), (None, prose(2)), (None, prose(20)), (None, prose(20)), (9, prose(21)), (9, prose(21) + " more"), (9, prose(22)), (10, ""), (None, " \n"), (11, None)]
    rows = [(d, t, "s1" if i % 3 else None, *(f"{c}{i % 2}" for c in "ABCDEFGHIJK")) for i, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same = lambda a, b: Counter(map(str, map(tuple, a))) == Counter(map(str, map(tuple, b)))
    one = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and same(one.collect(), rows)
    two = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    got = two.collect()
    assert two.columns == docs.columns and set(map(str, map(tuple, got))) <= set(map(str, rows))
    by_text = Counter(r.text for r in got)
    assert [by_text[prose(i)] for i in (*range(8), 20, 22)] == [1] * 10 and by_text[prose(21)] + by_text[prose(21) + " more"] == 1
    assert len([r for r in got if not (r.text or "").split()]) == 3 and [r.doc_id for r in got if r.text == prose(2)] == [2]
    three = corpus_pipeline.redact_secrets(spark, docs, str(tmp_path))
    assert three.columns == docs.columns and same(three.collect(), rows)
    four = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert four.columns == docs.columns
    took = mixing.mix(docs).collect()
    got = four.collect()
    words = lambda t: len((t or "").split())
    want = Counter()
    for r in took:
        want.update(min(r.size, r.taken - k * r.size) for k in range(-(-r.taken // r.size) if r.size else 0))
    assert Counter(words(r.text) for r in got) == want
    whole = [r for r in rows if words(r[1]) > 0]
    assert all(any((x.text, *x[2:]) == (r[1][: len(x.text)], *r[2:]) and x.doc_id == r[0] for r in whole) for x in got)
    five = corpus_pipeline.pack_tokens(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in five if r.start == 0) == Counter(r[0] for r in rows)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.pack_tokens(spark, docs, str(tmp_path)).count() == 0


def test_the_stages_keep_their_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_near_duplicates", "redact_secrets", "mix_sources", "pack_tokens"]
    assert ngram_join.GRAM == 5 and zlib.crc32(b"") == 0


def test_mixing_tells_rows_apart_that_differ_in_a_map(spark):
    rows = [(1, "a b c", "s", {"k": v}, [{"k": v}]) for v in range(4)] + [(1, "a b c", "s", None, None)] + [(2, "a b", "s", {"k": 1}, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, m map<string,int>, `n.x` array<map<string,int>>")
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    taken = {(r.doc_id, str(r.m), str(r["n.x"])) for r in out}
    assert taken == {(r[0], str(r[3]), str(r[4])) for r in rows}  # one and a half epochs take each row at least once
    assert sum(len(r.text.split()) for r in out) == int(1.5 * sum(len(r[1].split()) for r in rows))
