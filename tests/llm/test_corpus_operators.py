"""Repeats, near duplicates, search, mixing, toxicity, perplexity and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.fixtures import documents, key, prose, same, texts
from tidemill.llm import components, kneser_ney, mixing, simhash, suffix_dedup, topk, toxicity


def spans(rows: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        runs: list[list[int]] = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append([tuple(r) for r in runs])
    return out


def test_repeats_match_brute_force(spark):
    rows = texts()
    raw = [(t or "").encode() for _, t, _, _ in rows]
    expected = []
    for (i, *_), t, runs in zip(rows, raw, spans(raw, 400), strict=True):
        left = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(t)], strict=True))
        expected.append((i, len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest()))
    assert sum(e[2] > 0 for e in expected) >= 8
    same(suffix_dedup.removed_repeats(documents(spark)), expected)
    assert suffix_dedup.removed_repeats(documents(spark, [])).count() == 0


def test_repeats_of_other_lengths(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 300))), "en", "s") for i in range(60)] + [(60, "a" * 500, "en", "s")]
    raw = [t.encode() for _, t, _, _ in rows]
    for length, order in ((31, 2), (41, 3)):
        found = suffix_dedup.repeats(documents(spark, rows), lambda t, a, b: (str(list(zip(a.tolist(), b.tolist(), strict=True))),), "runs string", length=length, order=order).select("row.doc_id", "found.runs")
        same(found, [(row[0], str(runs)) for row, runs in zip(rows, spans(raw, length), strict=True)])


def test_texts_built_against_a_fixed_hash_stay(spark):
    """Differences that vanish for every base modulo 2^64: products of x^a - 1."""
    poly = [1]
    for a in (1, 2, 4, 8, 16, 32, 64, 128, 64, 64):
        poly = [x - y for x, y in zip([0] * a + poly, poly + [0] * a, strict=True)]
    scale = [16 * x for x in poly] + [0] * (400 - len(poly))
    assert max(map(abs, scale)) < 128
    one = bytes(64 + max(0, x) // 2 for x in scale)
    other = bytes(64 + max(0, -x) // 2 for x in scale)
    made = [t.decode() for t in (one, other, one[:-1] + b"!", other[:-1] + b"?")]
    found = suffix_dedup.removed_repeats(documents(spark, [(i, t, "en", "s") for i, t in enumerate(made)])).collect()
    assert len({*made}) == 4 and [r["n_removed"] for r in found] == [0] * 4


def test_a_passage_of_every_row(spark):
    line = prose(50, 90)
    rows = [(None if i % 3 == 0 else i // 2, prose(600 + i, 30) + " " + line + (" " + line if i % 50 == 0 else ""), "en", "s") for i in range(300)]
    raw = [t.encode() for _, t, _, _ in rows]
    found = suffix_dedup.removed_repeats(documents(spark, rows))
    same(found.select("doc_id", "n_bytes", "n_removed", "n_spans"), [(i, len(t), sum(b - a for a, b in s), len(s)) for (i, *_), t, s in zip(rows, raw, spans(raw, 400), strict=True)])


def test_repeats_keep_small_tables_in_few_files(spark, monkeypatch):
    """For every file in a local folder Hadoop starts processes, and while one starts, its executor's memory is read twice."""
    files = {}

    def noted(df, path, written=suffix_dedup.written):
        out = written(df, path)
        files[path.rsplit("/", 1)[-1]] = len(out.inputFiles())
        return out

    monkeypatch.setattr(suffix_dedup, "written", noted)
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    passages = [prose(700 + i, 300) for i in range(24)]
    rows = [(2 * i + k, f"{prose(800 + 2 * i + k, 300)} {k}{p}{'ab'[k]} {prose(900 + 2 * i + k, 300)}", "en", "s") for i, p in enumerate(passages) for k in range(2)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = suffix_dedup.removed_repeats(documents(spark, rows).repartition(16)).select("doc_id", "n_removed")
        same(found, [(2 * i + k, len(p.encode())) for i, p in enumerate(passages) for k in range(2)])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert files["packs"] == 16 and max(files.pop("flags"), files.pop("sample")) <= 2
    assert set(files) == {"packs", "twice", "texts"}


def test_difference_sets_cover():
    for q in (2, 3, 5, 11):
        v, d = suffix_dedup.difference_set(q)
        assert len(d) == q + 1 and {(i - j) % v for i in d.tolist() for j in d.tolist()} == set(range(v))
    with pytest.raises(ValueError):
        suffix_dedup.difference_set(6)


def test_packed_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (suffix_dedup.values_of(suffix_dedup.ascending(x)) == x).all()


def test_cut_text_keeps_whole_characters():
    raw = "aé日b".encode()
    text, gone = suffix_dedup.without_repeats(np.frombuffer(raw, np.uint8), np.array([2]), np.array([5]))
    assert text == "aé日b" and gone == 0
    assert suffix_dedup.without_repeats(np.frombuffer(raw, np.uint8), np.array([1]), np.array([5]))[0] == "a日b"


def fingerprint(t: str | None) -> int:
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fps: list[int], most: int) -> dict[int, int]:
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(b)] = find(a)
    return {x: find(x) for x in own}


def test_near_duplicates_match_brute_force(spark):
    rows = texts() + [(300 + i, prose(77, 400) + f" w{i}", "en", "s") for i in range(25)]
    fps = [fingerprint(t) for _, t, _, _ in rows]
    root = reachable(fps, 2)
    least: dict[int, int] = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    expected = [(i, f"{f:016x}", least.get(root[f])) for (i, *_), f in zip(rows, fps, strict=True)]
    assert len(set(fps)) > len(set(root.values())), "some links are between different fingerprints"
    same(simhash.near_duplicates(documents(spark, rows)), expected)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_large_groups_are_dealt_again(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 900:
        x = rng.choice(sorted(fps)[-50:])
        fps.add(x ^ 1 << rng.randrange(64))
    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    root = reachable(list(fps), 2)
    groups, expected = defaultdict(set), defaultdict(set)
    for x in fps:
        groups[found.get(signed(x), signed(x))].add(x)
        expected[root[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows: list[tuple] = [(i, [float(x) for x in v], None) for i, v in enumerate(rng.normal(0, 0.4, (230, 9)).astype(np.float32))]
    rows += [(300 + i, rows[7][1], "x") for i in range(9)] + [(0, rows[3][1], None)]
    bad = [(400, None, None), (450, [1.0, None] + [0.0] * 7, None), (500, [float("nan")] * 9, None), (550, [float("inf")] * 9, None), (600, [], None), (None, rows[1][1], None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F

    q = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v, _ in rows]
    expected = []
    for at, (i, a) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-int(a @ b), j) for other, (j, b) in enumerate(q) if other != at)[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert sum(e[0] == 0 for e in expected) == 10, "two rows have the identifier 0"
    same(found, expected)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(topk, "CELL_ROWS", 64)
    monkeypatch.setattr(topk, "CELL_QUERIES", 2)
    same(topk.top_k(df, F.col("vec_id") % 50 == 0, 5), expected)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.top_k(df.where("vec_id = 50 OR vec_id = 3"), F.col("vec_id") % 50 == 0, 5).count() == 1


def test_bit_slices_add_exactly():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 500, (130, 5))
    index = topk.slices_of(x, 9)
    q = np.array([3, -7, 0, 255, -256])
    slices, shift = topk.score_slices(index, q)
    at = np.arange(130)
    score = sum((((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w) for w, s in enumerate(slices) if s is not None)
    assert (score + shift == x @ q).all()


def test_targets_are_filled_like_water():
    totals = [("a", 10), ("b", 1000), ("c", 1), (None, 50)]
    goal = mixing.targets(totals)
    assert math.isclose(sum(goal.values()), 1061)
    assert all(goal[s] <= 3 * n for s, n in totals)
    assert goal["c"] == 3 and goal["a"] == 30
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mix_comes_near_its_targets(spark):
    rows = texts() + [(1000 + i, prose(i, 5 + i % 40), f"l{i % 3}", f"s{i % 5}") for i in range(400)]
    out = mixing.mixed(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] or -1 for r in out) == sorted(i or -1 for i, *_ in rows)
    size = {key((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, t, _, _ in rows}
    assert all(key((r["doc_id"], r["size"])) in size and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source_size"], r["target"]].append(r)
    for (total, target), own in by.items():
        assert sum(r["size"] for r in own) == total
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert sorted(map(tuple, out), key=key) == sorted(map(tuple, mixing.mixed(documents(spark, rows)).collect()), key=key)
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_targets_of_many_sources(spark, monkeypatch):
    rows = [(i, prose(i, i % 90), "en", None if i % 37 == 0 else f"s{i % 53}") for i in range(700)] + [(10_000, prose(5, 3000), "en", "huge"), (10_001, None, "en", "empty")]
    few = [tuple(r) for r in mixing.mixed(documents(spark, rows)).collect()]
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    rounded = lambda rs: sorted(((i, a, b, round(t, 6), *rest) for i, a, b, t, *rest in rs), key=key)
    assert rounded([tuple(r) for r in mixing.mixed(documents(spark, rows)).collect()]) == rounded(few)


def test_learning_matches_the_plain_recursion():
    """FTRL-proximal coordinate by coordinate, in plain numbers."""
    rng = random.Random(3)
    seen = [(sorted(rng.sample(range(30), 6)), int(rng.random() < 0.4)) for _ in range(200)]
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    ones = sum(y for _, y in seen)
    share = {1: len(seen) / (2 * ones), 0: len(seen) / (2 * (len(seen) - ones))}
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(toxicity.SEED + epoch).permutation(len(seen)).tolist():
            x, y = [*seen[k][0], toxicity.BIAS], seen[k][1]
            w = {i: weight(i) for i in x}
            g = share[y] * (1 / (1 + math.exp(-sum(w.values()))) - y)
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    found = toxicity.learned([(np.array([*x, toxicity.BIAS], np.int32), y) for x, y in seen])
    assert np.count_nonzero(found) == sum(weight(i) != 0 for i in list(z)) > 0
    assert all(math.isclose(found[i], weight(i), rel_tol=1e-9, abs_tol=1e-12) for i in list(z))


def labelled(n: int, seed: int = 0) -> tuple[list, list]:
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = prose(seed + i, 40).split()
        if bad:
            words[5:5] = ["vile", "grubber"]
            words.insert(20, random.Random(i).choice(["loathly", "loathing", "loathe"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


def test_toxicity_holds_out_and_finds(spark):
    rows, labels = labelled(600)
    rows += [(10_000 + i, t, lang, s) for i, (_, t, lang, s) in enumerate(texts())]
    truth = {i: toxic for i, _, toxic in labels}
    df = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (77_777, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(documents(spark, rows), df).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert toxicity.toxicity(documents(spark, []), df).count() == 0
    none = toxicity.toxicity(documents(spark, rows), df.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def plain_kneser_ney(trained: list[bytes], order: int = 5):
    """Probabilities of the last byte of n-grams, by the textbook's recursion."""
    counts = [Counter() for _ in range(order + 1)]
    for t in trained:
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    discount, total, left = {}, {}, {}
    for k in range(1, order + 1):
        n = Counter(min(c, 5) for c in counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        usual = {1: 0.5, 2: 1.0, 3: 1.5}
        discount[k] = {i: max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[i + 1] else usual[i] for i in (1, 2, 3)}
        total[k], left[k] = Counter(), Counter()
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            left[k][g[:-1]] += discount[k][min(c, 3)]

    def p(g: bytes) -> float:
        k = len(g)
        if not k:
            return 1 / 256
        lower = p(g[1:])
        if not total[k][g[:-1]]:
            return lower
        c = counts[k][g]
        return ((c - discount[k][min(c, 3)] if c else 0) + left[k][g[:-1]] * lower) / total[k][g[:-1]]

    return p


def test_perplexities_match_the_textbook(spark):
    rows = [(i, prose(i, 30), "en", "s") for i in range(40)] + [(100, None, "en", "s"), (101, "abc", "en", "s"), (102, "QZX 99|#" * 9, "en", "s"), (103, prose(5, 9), None, "s")]
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "doc_id long")
    out = {r["doc_id"]: r for r in kneser_ney.perplexities(documents(spark, rows), trusted).collect()}
    fold = lambda t: bytes(kneser_ney.FOLD[np.frombuffer(t.encode(), np.uint8)]) if t else b""
    p = plain_kneser_ney([fold(t) for i, t, lang, _ in rows if i < 30 and not out[i]["held_out"]])
    for i, t, lang, _ in rows:
        grams = [fold(t)[k : k + 5] for k in range(len(fold(t)) - 4)]
        assert out[i]["n_grams"] == len(grams)
        if not grams:
            assert out[i]["perplexity"] is None
        elif lang:
            assert math.isclose(out[i]["perplexity"], math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)), rel_tol=2e-3)
        else:
            assert math.isclose(out[i]["perplexity"], 256, rel_tol=2e-3)


def test_classifier_keeps_clean_texts(spark):
    rows = [(i, prose(i, 60), "en", "s") for i in range(150)] + [(1000 + i, prose(i, 60, "XQ#|&%").upper(), "en", "s") for i in range(10)] + [(5000 + i, t, lang, s) for i, (_, t, lang, s) in enumerate(texts())]
    out = {r["doc_id"]: r["kept"] for r in kneser_ney.classified(documents(spark, rows), spark.createDataFrame([(i,) for i in range(150)], "doc_id long")).collect()}
    assert sum(out[i] for i in range(150)) >= 145 and not any(out[1000 + i] for i in range(10))
    assert len(out) == len(rows)
    assert kneser_ney.classified(documents(spark, []), spark.createDataFrame([], "doc_id long")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = labelled(200, seed=5000)
    rows = [(i, t, lang, f"s{i % 4}") for i, t, lang, _ in rows] + [(10_000 + i, t, lang, s) for i, (_, t, lang, s) in enumerate(texts())]
    folder = str(tmp_path_factory.mktemp("corpus"))
    odd = ["root", "_own", "_key", "_score", "component_id", "own", "size", "row", "found", "group", "k1", "score", "copies", "copy", "range", "_text", "id", "key", "n"]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in odd)
    spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *range(len(odd))) for i, t, lang, s in rows], ddl).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def test_pipeline_stages_take_effect(spark, corpus):
    folder, rows, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    from tidemill.llm.common import work_dir, written

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), work_dir(spark, name))
        seen[name] = (before.collect(), docs.collect())
        if name != "byte_bpe":
            assert docs.columns == columns
    toxic = {i for i, _, t in labels if t}
    left = {r["doc_id"] for r in seen["toxicity"][1]}
    assert len(left & toxic) <= 0.1 * len(toxic) and len(left) >= len(rows) - len(toxic) - 5
    before, after = seen["simhash_near_dedup"]
    fps = {fingerprint(r["text"]) for r in before}
    assert len(after) == len(set(reachable(list(fps), 2).values()))
    before, after = seen["suffix_array_dedup"]
    runs = spans([(r["text"] or "").encode() for r in before], corpus_pipeline.PASSAGE)
    assert any(runs) and not any(spans([r["text"].encode() for r in after], corpus_pipeline.PASSAGE))
    whole = {r["doc_id"]: r["text"] or "" for r, s in zip(before, runs, strict=True) if not s}
    assert all(r["text"] == whole[r["doc_id"]] for r in after if r["doc_id"] in whole) and whole.keys() <= {r["doc_id"] for r in after}
    before, after = seen["source_mix"]
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rs)
    assert 0.8 * words(before) <= words(after) <= 1.2 * words(before)
    assert len(seen["byte_bpe"][1]) == len(after)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_pipeline_finds_near_copies_of_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = prose(900 + i, rng.choice((4, 30, 120, 400))).split()
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):  # copies of copies, around the threshold
            words = words[:]
            for _ in range(rng.randint(0, 1 + len(words) // 45)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((10 * i + k, " ".join(words).upper() if k == 2 else " ".join(words)))
    line = prose(3, 60)  # common, and not enough to be a copy
    rows += [(2000 + i, line + " " + prose(4000 + i, 60)) for i in range(60)] + [(3000, None), (3001, " \t")]

    def own(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    sets = [own(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for i, j in pairs:
        root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    expected = sorted(min(g) for g in groups.values())
    near = sum(sets[i] != sets[j] for i, j in pairs)
    assert near > 30 and len(expected) < len(rows) - 30
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == expected


def test_a_group_of_near_copies_beside_many_pairs_is_not_compared_in_all_pairs(spark, monkeypatch):
    from tidemill.llm import near_copies

    rng, rows = random.Random(21), []

    def changed(words):
        words = words[:]
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        return " ".join(words)

    base = prose(71, 120).split()
    group = [(i, changed(base)) for i in range(90)]
    for i in range(150):  # their keys have two members each: few pairs for each row on the whole
        words = prose(7000 + i, 120).split()
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, changed(words))]
    compared = []
    real = near_copies.written

    def counted(df, path):
        out = real(df, path)
        if path.endswith("-pairs"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in group + rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert left == [0, *range(1000, 1300, 2)]
    assert sum(compared) < 90 * 89 / 4  # of 4005 pairs in the group alone


def test_near_copies_of_few_words_whose_fingerprints_are_far_apart(spark):
    from tidemill.llm.near_copies import FAR, prints, shingle_sets

    words = [f"194777{c}" for c in "abcdefghi"]  # four shingles, and these with a fifth
    rows = [(1, " ".join(words[:8])), (2, " ".join(words)), (3, prose(5, 30))]
    raw = [t.encode() for _, t in rows[:2]]
    fps = prints(*shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])])))
    assert sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in (x.to_pylist() for x in fps)) > FAR
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_rows_of_unknown_size_are_counted(spark):
    from tidemill.llm.common import input_bytes, pieces_for

    rows = [(i, "é" * 1000, None, "s.1") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string")
    assert 4_000_000 <= input_bytes(df) < 5_000_000 and pieces_for(df, 1) == 4
    assert input_bytes(df.where("doc_id < 0")) == 0
