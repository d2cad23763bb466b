"""Operators on small hand-made rows."""

import json
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation, dedup, dialogue, metrics, retrieval, shaping
from tidemill.plans import shaping as plans
from tidemill.sources import files
from tidemill.streaming import admission


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_text_functions(spark):
    x = lambda f, v: one(spark, f(F.col("v")), v=v)
    assert x(T.normalize, " a \t b\r\n\r\n\r\n\r\nc  \rd ") == "a b\n\nc\nd"
    assert x(T.fold, "Đau ĐẦU Ñandú") == "dau dau nandu"
    assert x(T.nfkc, "ﬁ²") == "fi2" and x(T.nfkc, None) is None
    assert x(T.tokens, "Straße x_1, été!") == ["strasse", "x_1", "été"]
    assert x(T.token_estimate, "") == 1 and x(T.token_estimate, "a" * 301) == 101
    assert x(T.without_reasoning, "<think>a</think> b") == "b"
    assert x(T.without_reasoning, "plan</reasoning>b") == "b"
    assert x(T.without_reasoning, "<Thinking>b") is None
    assert x(T.questions, "**Where?** It is. 1? And\nwhy？") == ["Where?", "1?", "why？"] or x(T.questions, "Where? It is.\nwhy？") == ["Where?", "why？"]
    assert x(T.escaped_roles, "<|user|>") == "<​|user|​>"
    assert x(T.cited, "[s2] [S1] [S2]") == ["S2", "S1"]
    assert len(x(T.snippet, "word " * 100)) <= 280 and x(T.snippet, "word " * 100).endswith("…")


def test_words_end_at_marks_as_in_sql(spark):
    from tidemill.plans.text import CLAIMS

    x = lambda f, v: one(spark, f(F.col("v")), v=v)
    soft = lambda c: T.rewritten(c, CLAIMS)
    assert x(soft, "que laé, éOf the x, que lab, bof the") == "perhaps laé, éperhaps of the x, que lab, bof the"
    for pattern, text, there in ((r"\bund\b", "undß", True), (r"\bund\b", "und_", False), (r"^(?:la|de)\b", "laé", True), (r"\b(?:a|e)s?\b", "éas", True), (r"\d\b", "1é", True), (r"\\b", "é", False)):
        assert x(lambda c: c.rlike(T.plain_edges(pattern)), text) is there, pattern


def test_negation_scopes(spark):
    a = lambda t: one(spark, dialogue.affirmed(F.col("t"), "fever"), t=t)
    assert a("i have fever") == 1
    assert a("no fever") == 0 and a("there is no sign of any fever") == 0
    assert a("no pain and fever") == 1 and a("no cough, fever") == 1
    assert a("fever but no fever now") == 1
    assert a("feverish") == 0


def test_shingles_signatures_clusters(spark):
    words = ["one two three four five six seven"] * 2 + ["", "a b", "one two three four five six eight nine"]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, t string").select("doc_id", F.filter(F.split("t", " "), lambda x: x != "").alias("w"))
    runs = rows.select("doc_id", dedup.shingles(F.col("w")).alias("r"))
    assert {r["doc_id"]: len(r["r"]) for r in runs.collect()} == {0: 3, 1: 3, 2: 0, 3: 1, 4: 4}
    sig = rows.select("doc_id", dedup.signature(F.col("w")).alias("sig"))
    assert [r["doc_id"] for r in sig.where("sig IS NULL").collect()] == [2]
    sig = sig.where("sig IS NOT NULL")
    assert [tuple(r)[:2] for r in dedup.anchored_pairs(sig, 0.99).collect()] == [(0, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in dedup.clusters(chain).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert dedup.clusters(chain.limit(0)).count() == 0


def talk(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def test_structural_reasons(spark):
    good = talk(("system", "s"), ("user", "hello there"), ("assistant", "<think>x</think>How long?"), ("user", "two days"), ("assistant", "Any fever?"), ("user", "bye"))
    rows = [
        ("ok", good),
        ("malformed_messages", None),
        ("malformed_messages", []),
        ("invalid_role_or_content", talk(("doctor", "x"), *[(m["role"], m["content"]) for m in good])),
        ("unclosed_reasoning", talk(("user", "<think>x"), ("assistant", "y"))),
        ("empty_message", talk(("user", " "), ("assistant", "y"))),
        ("consecutive_same_role", talk(("user", "a"), ("user", "b"), ("assistant", "c"))),
        ("too_few_turns", talk(("user", "a"), ("assistant", "b"), ("user", "c"))),
        ("other_language", talk(("user", "日本"), ("assistant", "b"), ("user", "語"), ("assistant", "d"))),
    ]
    df = curation.cleaned(spark.createDataFrame([(w, m) for w, m in rows], "want string, messages array<struct<role:string,content:string>>"))
    out = df.select("want", curation.structural_reason(curation.Rules()).alias("reason"), "clean").collect()
    assert [(r["reason"] or "ok") for r in out] == [w for w, _ in rows]
    assert [m["content"] for m in out[0]["clean"]] == ["hello there", "How long?", "two days", "Any fever?"]


def test_quality_reasons(spark):
    def reasons(f, *turns):
        df = curation.cleaned(spark.createDataFrame([(talk(*turns),)], "messages array<struct<role:string,content:string>>"))
        return df.select(f(curation.Rules())).first()[0]

    assert reasons(curation.standard_reasons, ("user", "chest pain"), ("assistant", "Take 500 mg. You certainly have flu.")) == ["medication_dose", "certain_diagnosis", "emergency_not_escalated"]
    assert reasons(curation.standard_reasons, ("user", "chest pain"), ("assistant", "Call an ambulance")) == []
    assert reasons(curation.strict_reasons, ("user", "As an AI I feel ill"), ("assistant", "Fine."), ("user", "x"), ("assistant", "Where?")) == ["role_inversion_user", "no_followup_question", "insufficient_history_taking"]


def test_groups_stay_together(spark):
    rows = spark.range(5000).select((F.col("id") % 331).alias("g"))
    out = curation.group_split(rows, "g").collect()
    assert len(out) == 331 and sum(r["size"] for r in out) == 5000
    share = sum(r["size"] for r in out if r["split"] == "train") / 5000
    assert abs(share - 0.8) < 0.03
    assert sorted(map(tuple, out)) == sorted(map(tuple, curation.group_split(rows, "g").collect()))
    assert {r["group_id"]: r["split"] for r in out} != {r["group_id"]: r["split"] for r in curation.group_split(rows, "g", seed=1).collect()}
    with pytest.raises(ValueError):
        curation.group_split(rows, "g", ratios=(0.5, 0.5, 0.5))


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, [])], "id long, w array<string>")
    q = spark.createDataFrame([(9, "a"), (9, "a"), (9, "z")], "query_id long, term string")
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 5 / 3
    score = lambda tf, n: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert [(r["rank"], r["id"], r["score"]) for r in retrieval.bm25(docs, q, 5).orderBy("rank").collect()] == [(1, 2, round(score(2, 3), 6)), (2, 1, round(score(1, 2), 6))]
    assert retrieval.bm25(docs.limit(0), q, 5).count() == 0


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, "x")], "query_id long, rank int, source string")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "query_id long, source string")
    a, b = sorted(map(tuple, retrieval.ranking_metrics(ranked, wanted, 4).collect()))
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert a == (1, round(2 / 3, 6), 0.5, round((1 / math.log2(3) + 1 / math.log2(5)) / ideal, 6)) and b == (2, 0.0, 0.0, 0.0)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "a int, b int, g array<string>, f array<string>, v double, c string")
    assert metrics.kappa(empty, "a", "b").first()["kappa"] is None
    assert metrics.confusion(empty, F.col("a") == 1, F.col("b") == 1).first()["recall"] is None
    assert metrics.set_scores(empty, "g", "f").first()["f1"] == 0
    assert metrics.cluster_bootstrap(empty, "v", "c").first()["low"] is None
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert metrics.kappa(same, "a", "b").first()["kappa"] == 1
    opposite = spark.createDataFrame([(0, 1), (1, 0)], "a int, b int")
    assert metrics.kappa(opposite, "a", "b").first()["kappa"] == -1


def test_bootstrap_bounds(spark):
    rows = spark.range(2000).select((F.col("id") % 2).cast("double").alias("v"), (F.col("id") % 97).cast("string").alias("c"))
    r = metrics.cluster_bootstrap(rows, "v", "c").first()
    assert r["mean"] == 0.5 and 0.4 < r["low"] < 0.5 < r["high"] < 0.6 and r["n_clusters"] == 97
    assert tuple(r) == tuple(metrics.cluster_bootstrap(rows, "v", "c").first())


def test_windows_and_packs(spark):
    rows = [(1, 0, "system", "s s"), (1, 1, "user", "a b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e f g"), (1, 5, "user", "h"), (1, 6, "assistant", "i"), (2, 0, "user", "only"), (3, 0, "user", "w " * 30), (3, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = [(r["conv_id"], r["first"], r["last"], r["tokens"], r["reason"]) for r in shaping.chat_windows(turns, most=9, overlap=1).orderBy("conv_id", "window").collect()]
    assert out == [(1, 0, 1, 9, None), (1, 1, 2, 8, None), (2, None, None, None, "no_complete_turn"), (3, None, None, None, "turn_too_long")]
    ex = spark.createDataFrame([(i, [i] * n, [i] * n) for i, n in enumerate((3, 4, 8, 2, 1))], "k long, ids array<long>, labels array<long>")
    packs = [tuple(r["input_ids"]) for r in shaping.packed(ex, "k", 8, 99, 1).orderBy("pack").collect()]
    assert packs == [(0, 0, 0, 99), (1, 1, 1, 1, 99), (2,) * 8, (3, 3, 99, 4, 99)]


def test_long_conversations_are_packed_as_windows(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, 0, "user", words("a", 3)), (1, 1, "assistant", words("b", 4))]
    rows += [(2, 0, "system", "be brief")] + [(2, 1 + k, ("user", "assistant")[k % 2], words(f"c{k}-", 200)) for k in range(12)]
    rows += [(3, 0, "user", words("d", 600)), (3, 1, "assistant", words("e", 600)), (4, 0, "user", words("f", 1100))]
    rows += [(5, 0, "user", words("g", 24)), (5, 1, "assistant", words("h", 1000)), (6, 0, "user", None), (6, 1, "assistant", words("i", 5))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = plans.pack_examples(turns).orderBy("conv_id", "window").collect()
    crc = lambda text: [zlib.crc32(w.encode()) for w in text.split()]
    at = {(c, t): (r, crc(x or "")) for c, t, r, x in rows}
    expected = [(1, 0, [(1, 0), (1, 1)], None)]
    expected += [(2, k, [(2, 0), *((2, t) for t in range(1 + 2 * k, 5 + 2 * k))], None) for k in range(5)]
    expected += [(3, 0, None, "turn_too_long"), (4, 0, None, "no_complete_turn"), (5, 0, [(5, 0), (5, 1)], None), (6, 0, [(6, 0), (6, 1)], None)]
    assert len(found) == len(expected)
    for r, (conv, window, parts, reason) in zip(found, expected, strict=True):
        assert (r["conv_id"], r["window"], r["reason"]) == (conv, window, reason)
        if parts:
            assert r["ids"] == [i for p in parts for i in at[p][1]]
            assert r["labels"] == [i if at[p][0] == "assistant" else -100 for p in parts for i in at[p][1]]
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    out = plans.pack_sequences(spark, str(tmp_path)).collect()
    assert sorted((r["conv_id"], r["reason"]) for r in out if r["reason"]) == [(3, "turn_too_long"), (4, "no_complete_turn")]
    assert sum(r["n_ids"] or 0 for r in out) == 8 + 5 * 803 + 1024 + 6


def test_weighted_mix_repeats_small_sources(spark):
    rows = spark.range(30).select("id", F.when(F.col("id") < 10, "a").otherwise("b").alias("s"))
    out = shaping.weighted_mix(rows, "s", "id", {"a": 1.0, "b": 1.0}, "1").collect()
    assert sum(r["copies"] for r in out if r["s"] == "a") == sum(r["copies"] for r in out if r["s"] == "b") == 10
    with pytest.raises(ValueError):
        shaping.weighted_mix(rows, "s", "id", {"a": 0.0}, "1")


def test_chunks(spark):
    text = "intro line\n\n# First\n\n" + "Sentence one is here. " * 30 + "\n\n# Second\nshort\n\n" + "y" * 300
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string")
    out = files.chunks(rows, "id", "t", size=200, overlap=40).orderBy("ordinal").collect()
    assert {r["id"] for r in out} == {1} and all(len(r["chunk"]) <= 200 for r in out)
    assert [r["section"] for r in out][0] is None and {r["section"] for r in out} == {None, "First", "Second"}
    assert len({r["chunk_id"] for r in out}) == len(out)
    first = [r["chunk"] for r in out if r["section"] == "First"]
    assert any(b.startswith(a[-40:].partition(" ")[2]) for a, b in zip(first, first[1:], strict=False))
    with pytest.raises(ValueError):
        files.chunks(rows, "id", "t", size=200, overlap=200)


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "README.md").write_text("skip me")
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# Head\r\n\r\ntext")
    (tmp_path / "a.md.metadata.json").write_text(json.dumps({"title": " ", "source_id": "s1", "unknown": 1, "page": 2}))
    (tmp_path / "sub" / "b.html").write_text("<title>T</title><h2>H</h2><script>no</script><p>one<li>two</li>")
    (tmp_path / "c.json").write_text(json.dumps([{"text": "x", "title": "tx"}, {"content": "y"}]))
    (tmp_path / "d.json").write_text(json.dumps({"documents": [{"text": "z"}]}))
    (tmp_path / "e.bin").write_bytes(b"no")
    out = {(r["text"], r["title"], r["source_id"], r["review_status"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert out == {("# Head\n\ntext", None, "s1", "unreviewed"), ("## H\n\none\n\ntwo", "T", None, "unreviewed"), ("x", "tx", None, "unreviewed"), ("y", None, None, "unreviewed"), ("z", None, None, "unreviewed")}
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    with pytest.raises(NotImplementedError):
        files.documents(spark, str(tmp_path))


def test_index_is_written_whole(spark, tmp_path):
    chunks, vectors = spark.range(3), spark.range(3).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    path = f"{tmp_path}/index"
    files.write_index({"chunks": chunks, "vectors": vectors}, path)
    assert files.read_index(spark, path, 2)["chunks"].count() == 3
    with pytest.raises(FileExistsError):
        files.write_index({"chunks": chunks, "vectors": vectors}, path)
    files.write_index({"chunks": chunks, "vectors": vectors.limit(2)}, path, replace=True)
    with pytest.raises(ValueError):
        files.read_index(spark, path, 2)


def test_log_series(spark):
    lines = spark.createDataFrame([("step=1 loss: 2.5",), ("noise",), ("step 2 loss=1e-3",)], "value string")
    assert sorted(map(tuple, files.log_series(lines, "step", "loss").collect())) == [(1, 2.5), (2, 0.001)]


def test_admission_counts_admitted_hits_only(spark):
    at = [0, 10, 20, 30, 59, 61, 62, 71, 200]
    rows = spark.createDataFrame([(i, 1, "p", t) for i, t in enumerate(at)], "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = [r["retry_after"] for r in admission.admitted(rows, 3, 60.0).orderBy("event_id").collect()]
    assert out == [0, 0, 0, 30, 1, 0, 8, 0, 0]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, "p", 1000 + i * 5) for i in range(20)], "event_id long, user_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("admitted", admission.admitted_stream(stream(), 3, 60.0)), ("unique", admission.unique_stream(stream(), "user_id"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    batch = sorted(map(tuple, admission.admitted(rows, 3, 60.0).collect()))
    assert sorted(map(tuple, spark.table("admitted").collect())) == batch
    assert spark.table("unique").count() == 2


def test_sheets_and_levels(spark, tmp_path):
    from tidemill.sources import sinks

    rows = spark.createDataFrame([(1, "a, \"q\"", "standard", "train"), (2, "b", "strict", "test")], "id long, t string, level string, split string")
    sinks.write_sheet(rows, f"{tmp_path}/sheet", ["id", "t"], ["score"])
    assert [tuple(r) for r in sinks.read_sheet(spark, f"{tmp_path}/sheet").orderBy("id").collect()] == [("1", 'a, "q"', None), ("2", "b", None)]
    sinks.write_sheet(rows.limit(0), f"{tmp_path}/sheet", ["id", "t"], ["score"], keep_edits=True)
    assert sinks.read_sheet(spark, f"{tmp_path}/sheet").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_sheet(rows, f"{tmp_path}/sheet", ["id", "t"], ["score"])
    manifest = sinks.write_levels(rows, f"{tmp_path}/levels")
    assert {(r["level"], r["split"], r["n"]) for r in manifest.collect()} == {("standard", "train", 1), ("strict", "test", 1)}
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, sinks.write_levels(rows.repartition(3), f"{tmp_path}/again").collect()))
    assert sinks.read_json_lines(spark, f"{tmp_path}/levels", "id long, t string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n[oops\n')
    with pytest.raises(Exception):
        sinks.read_json_lines(spark, f"{tmp_path}/bad.jsonl", "id long").collect()
