"""Terms, states, simulations, places for models, indexes, and sources, against hand-made rows and plain versions."""

import json
import math
import random
import sys
import types

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as T
from tidemill.operators import curation, dedup, index, metrics, providers, shaping, spans, state
from tidemill.sources import files, sinks
from tidemill.streaming import conversation

FEVER = spans.Term("fever", ("fever", "high temperature"), ("fiévre",), not_after="yellow")
V = state.Vocabulary(
    terms=(FEVER, spans.Term("cough", ("cough(?:ing)?",)), spans.Term("chest pain", ("chest pain",))),
    scalars={"place": (r"in (?:the|my) \w+",), "severity": (r"\d+/10",)},
    lists={"drugs": ((r"aspirin|ibuprofen",), (r"no drugs",))},
    when=(r"for \d+ days", r"since \w+"),
    topics={"timing": r"\bhow long\b", "place": r"\bwhere\b", "drugs": r"\bdrugs\b", "severity": r"\bhow bad\b", "danger": r"\bdanger\b"},
    urgent=("chest pain",),
    core=("timing", "place", "drugs"),
    most=5,
)


def test_terms_with_places():
    scope = spans.Scope(neutral="not only", always="without fever", idiom="pitch")
    found = lambda t, term=FEVER: spans.find(t, term, scope)
    assert found("Fever, and a FEVER") == [(0, 5, True), (13, 18, True)]
    assert found("no fever but high temperature") == [(3, 8, False), (13, 29, True)]
    assert found("yellow fever") == [] and found("feverish") == []
    assert found("not only fever") == [(9, 14, True)] and found("fever pitch") == [(0, 5, False)]
    assert found("La fiévre") == [(3, 9, True)] and found("la fievre") == []
    assert spans.first("a cough, then fever", ("fever", "cough")) == (2, 7) and spans.first("", ("x",)) is None
    assert spans.trimmed(" x, fever. ", 1, 10) == "x, fever"
    assert spans.folded("ĐaİÉ") == "daİe" or len(spans.folded("ĐaİÉ")) == 4


def test_a_denial_ends_at_the_next_match():
    once, each = spans.Scope(), spans.Scope(anew=True)
    said = lambda text, scope: [yes for _, _, yes in spans.find(text, FEVER, scope)]
    assert said("no fever or fever", once) == [False, False] and said("no fever or fever", each) == [False, True]
    assert said("no fever, no fever or high temperature", each) == [False, False, False]  # of another pattern: no end


def test_spans_in_batches(spark):
    df = spark.createDataFrame([(1, "no cough, fever"), (2, None), (3, "")], "id long, t string")
    out = {r["id"]: [(x["label"], x["start"], x["said"], x["affirmed"]) for x in r["s"]] for r in df.select("id", spans.spans(F.col("t"), list(V.terms)).alias("s")).collect()}
    assert out == {1: [("cough", 3, "cough", False), ("fever", 10, "fever", True)], 2: [], 3: []}


def say(*turns):
    return list(zip(["user", "assistant"] * len(turns), turns, strict=False))


def test_states():
    s = state.fold(say("My mother has a cough and no fever for 3 days.", "Where is it?", "In my chest", "Any drugs?", "No"), V)
    assert (s["subject"], s["chief"], s["present"], s["denied"], s["duration"], s["onset"]) == ("other", "cough", ["cough"], ["fever"], "for 3 days", None)
    assert s["slots"] == {"place": ("In my chest", 2, "said"), "drugs": ("none", 4, "answer")} and s["answered"] == ["drugs"]
    assert s["asked"] == {"place": 1, "drugs": 1} and s["missing"] == [] and s["status"] == "ready"
    assert state.fold([], V)["status"] == "collecting" and state.fold([("assistant", "Where?")], V)["missing"] == ["chief"]
    assert state.fold(say("Could it be fever?"), V)["chief"] is None, "a question reports nothing"
    assert state.fold(say("chest pain"), V)["status"] == "emergency"
    unnamed = state.fold(say("cough", "Any danger signs?", "yes"), V)
    assert unnamed["flags"] == ["unspecified"] and state.fold(say("cough", "Any danger signs?", "no"), V)["answered"] == ["danger"]
    assert state.fold(say("cough", "Where?", "I don't know"), V)["slots"] == {}
    long = " ".join(["word"] * 30)
    assert "place" not in state.fold(say("cough", "Where?", long), V)["slots"]
    asks = state.fold(say("cough since Monday in my chest, what is wrong"), V)
    assert asks["requests"] and asks["status"] == "ready" and asks["missing"] == ["drugs"]
    assert state.fold(say("I am 40 years old, fever for 2 days"), V)["duration"] == "for 2 days"
    assert state.fold(say(*["cough", "Where?"] * 6), V)["status"] == "ready", "as many questions as there may be"


def test_states_in_batches_and_streams(spark, tmp_path):
    rows = [(1, 0, "user", "cough"), (1, 1, "assistant", "Where?"), (1, 2, "user", "in my chest"), (2, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["s"] for r in curation.conversations(turns).select("conv_id", state.states(F.col("messages"), V).alias("s")).collect()}
    assert out[1]["chief"] == "cough" and [(x["slot"], x["value"]) for x in out[1]["slots"]] == [("place", "in my chest")] and out[2]["status"] == "collecting"
    timed = turns.withColumn("ts", F.timestamp_seconds(1000 + F.col("turn")))
    timed.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = conversation.state_stream(spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in"), V)
    q = stream.writeStream.format("memory").queryName("talk").outputMode("append").option("checkpointLocation", f"{tmp_path}/talk").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    found = {r["conv_id"]: (r["turn"], r["status"], r["chief"], r["missing"]) for r in spark.table("talk").collect()}
    assert found == {1: (2, "asking", "cough", ["timing", "drugs"]), 2: (0, "collecting", None, ["chief"])}


def test_closed_loop(spark):
    said = {"chief": "What is it?", "timing": "How long?", "place": "Where?", "drugs": "Any drugs?"}
    done = state.simulate("cough", {"timing": "for 2 days", "place": "in my chest", "drugs": "no"}, V, state.by_order(V), said.__getitem__)
    assert done["asked"] == ["timing", "place", "drugs"] and done["complete"] and done["stopped"] and done["repeated"] == done["off_target"] == 0
    lost = state.simulate("cough", {}, V, state.by_order(V), lambda slot: "Well?")
    assert lost["n_questions"] == V.most and lost["off_target"] == V.most and not lost["complete"]
    again = state.simulate("cough", {}, V, state.by_order(V), said.__getitem__)
    assert again["repeated"] == V.most - 1
    cases = spark.createDataFrame([("a", "cough", {"timing": "for 2 days", "place": "in my chest", "drugs": "no"}, False), ("b", "chest pain", {}, True), ("c", None, None, False)], "case_id string, opening string, answers map<string,string>, expected boolean")
    total = state.loop_summary(state.simulated(cases, V, state.by_order(V), lambda s: said.get(s, "?"))).first()
    assert total["cases"] == 3 and total["recall"] == 1.0 and math.isclose(total["complete_rate"], 1 / 3, abs_tol=1e-5)


def test_places_for_models(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, None), (3, "A")], "id long, t string")
    v = {r["id"]: r["v"] for r in texts.select("id", providers.embedded(F.col("t"), providers.hashed_words(8), 8).alias("v")).collect()}
    assert all(math.isclose(sum(x * x for x in y), 1) for y in v.values()) and v[2][0] == 1
    with pytest.raises(Exception, match="finite numbers"):
        texts.select(providers.embedded(F.col("t"), providers.hashed_words(8), 4)).collect()
    pairs = spark.createDataFrame([(1, 10, "a b", "b c"), (1, 11, "a b", "a b"), (1, 9, "a b", "x b"), (2, 5, "", "x")], "query_id long, id long, query string, text string")
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in providers.reranked(pairs, 2, providers.shared_words).orderBy("query_id", "rank").collect()] == [(1, 1, 11, 1.0), (1, 2, 9, 0.5), (2, 1, 5, 0.0)]
    with pytest.raises(Exception, match="finite score"):
        providers.reranked(pairs, 2, lambda: lambda p: [float("nan")] * len(p)).collect()
    talks = spark.createDataFrame([(1, [("user", "hi")]), (2, None)], "id long, messages array<struct<role:string,content:string>>")
    out = {r["id"]: r["reply"] for r in providers.generated(talks, lambda: lambda convs: [f"{len(c)}:{c[0]['content'] if c else ''}" for c in convs]).collect()}
    assert out == {1: "1:hi", 2: "0:"}


def test_index_from_documents_to_citations(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# Fever\n\nFever is heat."), (2, "Cough is noise."), (3, "Cough  is noise."), (4, " \n "), (5, None)], "doc_id long, text string")
    made = index.built(docs, providers.hashed_words(16), 16)
    info = made["manifest"].first()
    assert (info["n_documents"], info["n_unique"], info["dim"]) == (5, 2, 16) and made["chunks"].count() == made["vectors"].count() == 2
    assert index.built(docs.orderBy(F.desc("doc_id")), providers.hashed_words(16), 16)["manifest"].first() == info
    files.write_index({k: made[k] for k in ("chunks", "vectors")}, f"{tmp_path}/index")
    back = files.read_index(spark, f"{tmp_path}/index", 16)
    queries = spark.createDataFrame([("f", "fever heat"), ("f", " "), ("c", "noise")], "topic string, query string")
    for reranker in (None, providers.shared_words):
        found = index.retrieved(back["chunks"], back["vectors"], queries, providers.hashed_words(16), 16, k=1, reranker=reranker)
        cited = index.cited(found, back["chunks"])
        assert {(r["topic"], r["doc_id"], r["citation_id"]) for r in cited.collect()} == {("f", 1, "S1"), ("c", 2, "S1")}
    said = {r["topic"]: r["context"] for r in index.context(cited, F.col("doc_id").cast("string"), F.col("snippet")).collect()}
    assert said["c"] == "[S1] 2\nCough is noise."


def test_chunks_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["été", "Straße"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) + rng.choice(["", "\r\n\r\n\r\n# Part\n x  y\t", "\n"]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3], texts[3] + "  ", "", None])], "doc_id long, text string")
    # one pass gives what the columns give
    plain = files.chunks(docs.select("doc_id", T.normalize(T.nfkc(F.col("text"))).alias("text")), "doc_id", "text", 200, 40)
    made = files.normalized_chunks(docs, "doc_id", "text", 200, 40, at_once=7)
    assert sorted(made.drop("hash").collect()) == sorted(plain.select("id", "ordinal", "section", "chunk", "chunk_id").collect())
    # of equal texts the first one's chunks; hashes and one row a chunk are all that is shuffled
    chunks = index.built(docs, providers.hashed_words(16), 16, 200, 40)["chunks"]
    assert {r["doc_id"] for r in chunks.select("doc_id").distinct().collect()}.isdisjoint({60, 61, 62, 63})
    assert chunks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    queries = spark.createDataFrame([(str(i), " ".join(rng.choice(words) for _ in range(5))) for i in range(8)], "topic string, query string")
    chunks = curation.kept(chunks, "chunks")
    vectors = chunks.select("id", providers.embedded(F.col("text"), providers.hashed_words(16), 16).alias("v"))
    found = lambda: sorted(map(tuple, index.retrieved(chunks, vectors, queries, providers.hashed_words(16), 16, reranker=providers.shared_words).collect()))
    here = found()
    monkeypatch.setattr(index, "FEW", 0)
    assert len(here) == 32 and here == found()


def test_json_records_and_pages(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps({"documents": ["plain", {"content": "nested", "title": "top", "metadata": {"title": "under", "organization": "org", "page": 3}}, {"text": "  "}]}))
    (tmp_path / "a.json.metadata.json").write_text(json.dumps({"organization": "side", "language": "en"}))
    (tmp_path / "b.json").write_text(json.dumps({"metadata": {"organization": "org"}, "text": "one"}, indent=3))
    out = {r["text"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(out) == {"plain", "nested", "one"}
    assert [out["nested"][c] for c in ("title", "organization", "language", "page")] == ["top", "org", "en", 3] and out["plain"]["organization"] == "side"
    hashed = out["one"]["document_hash"]
    (tmp_path / "b.json").write_text('{"text": "one", "metadata": {"organization": "org"}}')
    assert {r["text"]: r["document_hash"] for r in files.documents(spark, str(tmp_path)).collect()}["one"] == hashed, "order and white space don't matter"
    pages = types.SimpleNamespace(PdfReader=lambda f: types.SimpleNamespace(metadata=types.SimpleNamespace(title="T"), pages=[types.SimpleNamespace(extract_text=lambda x=x: x) for x in ("one", " ", None, "four")]))
    monkeypatch.setitem(sys.modules, "pypdf", pages)
    assert [(p["page"], p["text"], p["title"]) for p in files.pages_of_pdf(b"")] == [(1, "one", "T"), (4, "four", "T")]
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(ImportError, match="pypdf"):
        files.pages_of_pdf(b"")


def test_logs_cases_and_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("step=1 loss=2.5\nstep=2 loss=2.0\n".encode("utf-16"))
    (tmp_path / "b.log").write_text("step: 3 loss: 1.5\r\nnothing\r\n")
    found = files.log_series(files.log_lines(spark, f"{tmp_path}/*.log", "step"), "step", "loss")
    assert sorted(map(tuple, found.collect())) == [(1, 2.5), (2, 2.0), (3, 1.5)]
    (tmp_path / "rows.jsonl").write_text("".join(f'{{"id": {i}}}\n\n' for i in range(5)))
    rows = sinks.read_json_lines(spark, f"{tmp_path}/rows.jsonl", "id long", usable=F.col("id") != 0, limit=3)
    assert rows.count() == 3 and rows.where("id = 0").count() == 0
    checked = sinks.validated(rows, {"small": F.col("id") < 3}, limit=10)
    assert {r["id"]: r["reasons"] for r in checked.collect()}.items() <= {1: [], 2: [], 3: ["small"], 4: ["small"]}.items()
    with pytest.raises(ValueError):
        sinks.validated(rows, {}, limit=0)
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"id": "a", "words": ["x"]}, {"id": "b"}]}))
    assert [tuple(r) for r in sinks.read_cases(spark, f"{tmp_path}/cases.json", "id string, words array<string>").collect()] == [("a", ["x"]), ("b", None)]


def test_contained_texts(spark):
    r = random.Random(3)
    words = ["ab", "cd", "efg", "h"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 25))) for _ in range(80)]
    probes = ["", "h", "ab cd", "b c", "ab ab h", "d efg a", "h h h h", *(t[2:-1] for t in texts[:12]), " ".join(["ab"] * 30)]
    rows = spark.createDataFrame([*enumerate(texts), (1000, None)], "id long, text string")
    asked = spark.createDataFrame([*enumerate(probes), (1000, None)], "probe_id long, probe string")
    found = sorted(map(tuple, dedup.contained(rows, asked, longest=3).collect()))
    assert found == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(probes) if p in t)
    assert dedup.contained(rows, asked.limit(0)).count() == 0


def test_ranks_and_places(spark):
    r = random.Random(5)
    rows = [(i % 3 or None, round(r.gauss(0, 10), 3) if i % 11 else None) for i in range(400)] + [(7, 2.0)] * 9
    df = spark.createDataFrame(rows, "g long, v double")
    expected = {}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        expected[g] = (round(own[math.ceil((len(own) - 1) * 0.9 - 1e-6)], 1), len(own))
    assert {x["g"]: (x["value"], x["n"]) for x in metrics.nearest_rank(df, "g", "v", 0.9, steps=8).collect()} == expected
    named = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None) for i in range(300)], "id long, s string").withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    placed = shaping.hash_places(named, ["s"], "h", "id").collect()
    for s in ("a", "b", None):
        own = sorted((x["h"], x["id"]) for x in placed if x["s"] == s)
        assert {x["id"]: x["place"] for x in placed if x["s"] == s} == {i: k for k, (_, i) in enumerate(own, 1)}
    a, b = (spark.createDataFrame([(x,) for x in xs], "id long") for xs in (range(0, 500, 2), [*range(0, 300, 2), *range(301, 500, 2)]))
    assert tuple(metrics.same_order(a, b, "id").first()) == (250, 250, 151, False)
    assert tuple(metrics.same_order(a, a, "id").first()) == (250, 250, None, True)
    assert tuple(metrics.same_order(a.limit(0), a.limit(0), "id").first()) == (0, 0, None, True)


def test_bootstrap_draws_whole_clusters(spark):
    rows = [(f"c{i % 7}", float(i * i % 13)) for i in range(60)] + [("c1", None)]
    df = spark.createDataFrame(rows, "c string, v double")
    sums, means = metrics.drawn_means(df, "v", "c", 50, 3)
    import hashlib

    names = sorted({c for c, _ in rows}, key=lambda c: (hashlib.md5(c.encode()).hexdigest(), c))
    values = {c: [v for d, v in rows if d == c and v is not None] for c in names}
    for x in means.collect():
        drawn = [values[names[int(hashlib.md5(f"3:{x['r']}:{j}".encode()).hexdigest()[:15], 16) % 7]] for j in range(7)]
        flat = [v for vs in drawn for v in vs]
        assert math.isclose(x["m"], sum(flat) / len(flat))
    assert sums.count() == 7 and means.count() == 50
    none = metrics.cluster_bootstrap(df.limit(0), "v", "c", 20).first()
    assert none["mean"] is None and none["low"] is None and none["n_clusters"] == 0


def test_digests_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("a", f"line {i}") for i in range(50)] + [("b", "x")], "g string, line string").withColumn("h", F.sha2("line", 256))
    one, two = (dedup.digests(x, "g", "h", "line").orderBy("g").collect() for x in (df, df.repartition(5).orderBy(F.desc("line"))))
    assert one == two and one[0]["digest"] != dedup.digests(df.union(df.limit(1)), "g", "h", "line").orderBy("g").first()["digest"]
