"""Nearest neighbours, quality, toxicity, licences, chat formatting and the pipeline."""

import collections
import itertools
import json
import math
import re
import zlib

import numpy as np
import pytest
from llm_fixtures import rows, word_list

import corpus_pipeline
import stockloom.llm.queries as queries
from stockloom.llm import ann, chat, licenses, neardup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_nearest_is_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6) * rng.uniform(0.2, 3)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(90)]  # copies of one vector
    vectors += [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [math.nan] * 6), (504, [math.inf] * 6),
                (505, [1.0, 2.0]), (None, [1.0] * 6), (7, vectors[7][1])]
    frame = spark.createDataFrame([(i, v, 9) for i, v in vectors], "vec_id long, embedding array<double>, score long")
    got = collections.defaultdict(list)
    for r in ann.nearest(frame, frame.where("vec_id % 20 = 0 or vec_id = 301"), k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    known = {i: np.array(v) for i, v in vectors[:390]}
    ids = np.array(sorted(known))
    every = np.array([known[i] for i in ids])
    found = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0 or i == 301}
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
        assert all(s == pytest.approx(float(known[q] @ known[i]), abs=1e-12) for _, i, s in hits)
        score = every @ known[q]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -np.round(score, 9)))[:20]].tolist())
        found, total = found + len(best & {h[1] for h in hits}), total + 20
    assert found >= 0.95 * total
    few = frame.where("vec_id < 5")
    assert ann.nearest(few, few, k=20).count() == 20  # all four others of each
    assert ann.nearest(frame.where("vec_id = 500"), frame, k=3).count() == 0
    assert ann.nearest(frame.where("false"), frame.where("false")).count() == 0


def test_recall_on_the_table(spark):
    got = collections.defaultdict(set)
    for r in queries.QUERIES["op2_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect():
        got[r["query_id"]].add(r["vec_id"])
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    votes = np.full((20000, len(quality.LABELLERS)), -1, np.int8)
    for k in range(len(quality.LABELLERS)):
        right = rng.random(20000) < np.where(truth, 0.95, 0.7)
        votes[:, k] = np.where(rng.random(20000) < 0.2, -1, np.where(right, truth, ~truth))
    codes, counts = np.unique(quality._code(votes), return_counts=True)
    assert (quality._patterns(quality._code(votes)) == votes).all()
    post, facts = quality.estimate(quality._patterns(codes), counts.astype(float))
    assert facts["good"] == pytest.approx(0.8, abs=0.02)
    assert all(facts[n] == pytest.approx((0.95, 0.7), abs=0.03) for n in quality.LABELLERS)
    assert ((post[np.searchsorted(codes, quality._code(votes))] > 0.5) == truth).mean() > 0.98


def test_quality_against_labels_and_odd_texts(spark, docs, empty):
    found = {r["doc_id"]: r for r in queries.QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    marks = [(r["quality"], found[r["doc_id"]]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["doc_id"] in found]
    assert np.mean([r["kept"] for y, r in marks if y == 1]) > 0.97
    assert np.mean([r["kept"] for y, r in marks if y == 0]) < 0.3
    got = quality.score(docs, quality.fit(docs)).collect()
    assert len(got) == len(rows()) and all(0 <= r["quality"] <= 1 for r in got) and "source" in got[0].asDict()
    assert quality.score(empty, quality.fit(empty)).count() == 0


def test_quality_shares_by_definition():
    text = "The THE the stop. stop. ### a1! end"
    data = np.frombuffer(text.encode(), np.uint8)
    votes, _, _, n = quality._read(data, np.array([0, len(data)]))
    assert n.tolist() == [len(word_list(text))]
    by = dict(zip(quality.LABELLERS, votes[0].tolist()))
    assert by["repeats"] == 0 and by["symbols"] == 0 and by["variety"] == -1


def test_variety_judges_long_texts_like_short_ones():
    rng = np.random.default_rng(4)
    k = quality.LABELLERS.index("variety")

    def vote(words: list[str]) -> int:
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return int(quality._read(data, np.array([0, len(data)]))[0][0, k])

    for n in (100, 3_000, 3_001, 60_000):
        words = [f"w{x}" for x in rng.zipf(1.3, n) % 5000]
        last, new = {}, 0
        for i, word in enumerate(words):  # the definition, word by word
            new += i - last.get(word, -quality.WINDOW - 1) > quality.WINDOW
            last[word] = i
        assert vote(words) == (1 if new / n > 0.35 else 0 if new / n < 0.15 else -1)
        assert vote([f"w{i % 10}" for i in range(n)]) == 0
        assert vote([f"w{i % 5000}" for i in range(n)]) == 1


def test_restored_words(spark):
    costs = toxicity.trigram_costs(spark.read.parquet(f"{SF}/documents.parquet"))
    made = toxicity.Restorer(costs)
    for hidden, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("l0ser", "loser")):
        assert word in made.words(f"and {hidden} that")[0]
    assert made.words("plain words only") == ({"plain", "words", "only"}, set())
    assert made.words("") == (set(), set())


def _cheapest(token: str, costs: np.ndarray) -> str:
    """The text of the cheapest of all paths through the lattice, each one priced on its own."""
    chars = [*token.lower(), " "]
    found = []
    for path in itertools.product(*(toxicity._arcs(ch, before) for ch, before in zip(chars, ["", *chars]))):
        shown = "".join(" " if letter in toxicity.SEPARATORS and letter else letter for letter, _ in path)
        classes = [0, 0, *toxicity._CLASS[list(shown.encode())].tolist()]
        cost = sum(price for _, price in path) + sum(float(costs[t]) for t in zip(classes, classes[1:], classes[2:]))
        found.append((cost, shown.strip()))
    return min(found)[1]


def test_the_decode_is_the_cheapest_path():
    rng = np.random.default_rng(3)
    costs = rng.gamma(2.0, 1.0, (64, 64, 64)).astype(np.float32)
    for _ in range(150):
        token = "".join(rng.choice(list("ab1!0.-ll€"), rng.integers(1, 8)))
        assert toxicity.restore(token, costs) == _cheapest(token, costs), token
    assert toxicity.restore("", costs) == ""


def test_a_long_run_is_decoded_as_one(spark):
    costs = toxicity.trigram_costs(spark.read.parquet(f"{SF}/documents.parquet"))
    for at in range(50, 70):  # no place in a run is a seam
        assert "idiot" in toxicity.restore("x" * at + ".1d10t.", costs).split()
    whole = toxicity.restore("1d10t-" * 40_000, costs)
    assert whole.count("idiot") == 40_000


def test_toxicity_is_learnt_and_held_out_rows_are_not_read(spark, docs, empty):
    rng = np.random.default_rng(3)
    calm = ["river", "stone", "window", "garden", "letter", "bridge", "summer", "market"]
    bad = ["grumblefuzz", "snarkwort", "blatherskite"]
    data, marks = [], []
    for i in range(600):
        words = [calm[k] for k in rng.integers(0, 8, 30)]
        toxic = i % 4 == 0
        if toxic:
            words[5] = bad[i % 3]
            words[9] = bad[(i // 3) % 3] + "ish"
        train = zlib.crc32(str(i).encode()) % 3 != 1
        data.append((i, " ".join(words)))
        marks.append((i, int(toxic) if train else 1 - int(toxic)))  # held-out labels lie
    frame, labels = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = toxicity.score(frame, model).withColumn("out", toxicity.held_out("doc_id")).collect()
    assert {r["doc_id"] for r in got if r["out"]} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((r["toxicity"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in got)
    hidden = spark.createDataFrame([(1, "river gruuumblefuzz stone sn4rkw0rt"), (2, None), (3, ""), (4, "stone " * 5000)], "doc_id long, text string")
    one, *clean = [r["toxicity"] for r in toxicity.score(hidden, model).orderBy("doc_id").collect()]
    assert one >= 0.7 and max(clean) < 0.1
    assert toxicity.score(docs, model).count() == len(rows())
    assert toxicity.score(empty, toxicity.fit(empty, labels.where("false"))).count() == 0


def cosine(line, template, idf, rare):
    a, b = licenses._counts(line), licenses._counts(template)
    va, vb = {w: n * idf.get(w, rare) for w, n in a.items()}, {w: n * idf[w] for w, n in b.items()}
    norm = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(x * vb.get(w, 0) for w, x in va.items()) / norm if norm else 0.0


def test_licences_are_brute_force(spark):
    mit = licenses.TEMPLATES["MIT"]
    files = [("a/LICENSE", "\n" + mit[1] + "\nmore words here"), ("a/b/c/x.py", "import os\nprint(1)"), ("a/b/y.py", "Released under the MIT Licence"),
             ("a/d/z.py", "# Licensed under the Apache License, Version 2.0\ncode"), ("a/d/e/w.py", "code\nAll rights reserved."), ("a/d/e/v.py", None), ("q.py", ""),
             (None, "All rights reserved"), ("a/b/c/x.py", "import os\nprint(1)"), ("long", "word " * 3000 + "\nLicensed under CC BY 4.0\n" + "word " * 3000), ("license the apache", "the of and version")]
    frame = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(files)], "doc_id long, path string, text string, score string")
    got = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    n = len(files)
    vocabulary = {w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses._counts(t)}
    held = collections.Counter(w for _, t in files for w in set(licenses._counts(t or "")) & vocabulary)
    idf, rare = {w: math.log((n + 1) / (held[w] + 1)) + 1 for w in vocabulary}, math.log(n + 1) + 1
    own, speaks = {}, {}
    for i, (path, text) in enumerate(files):
        units = [*(text or "").split("\n"), text or ""]
        scored = [(-round(cosine(u, t, idf, rare), 9), name, k) for k, u in enumerate(units) for name, ts in licenses.TEMPLATES.items() for t in ts]
        fit = [s for s in scored if -s[0] >= licenses.THRESHOLD]
        own[i] = min(fit)[:2] if fit else None
        first = next((k for k, u in enumerate(units[:-1]) if licenses._counts(u)), None)
        head = [s for s in fit if s[2] == first and first is not None]
        if head and path:
            folder = path.rpartition("/")[0]
            speaks[folder] = min(speaks.get(folder, (9,)), (min(head)[0], path, min(head)[1]))
    for i, (path, _) in enumerate(files):
        row = got[i]
        if own[i]:
            assert (row["status"], row["licence"], row["score"]) == ("own", own[i][1], pytest.approx(-own[i][0], abs=2e-9))
            continue
        at = path.split("/")[:-1] if path else None
        source = next((d for k in range(len(at), -1, -1) if (d := "/".join(at[:k])) in speaks), None) if path else None
        assert (row["licence"], row["from_dir"]) == ((speaks[source][2], source) if source is not None else (None, None))
    assert got[1]["status"] == "inherited" and got[1]["from_dir"] == "a/b" and got[5]["from_dir"] == "a/d"
    assert licenses.scan(frame.where("false")).count() == 0


def test_licences_pass_on_from_any_line(spark):
    files = [("a/LICENSE.txt", "Project title\nCopyright the authors\nReleased under the MIT License"), ("a/x.py", "import os"),
             ("b/1", "prose and more prose\nLicensed under CC BY 4.0"), ("b/2", "prose"), ("b/c/3", None),
             ("d/4", "This work\nis licensed under a\nCreative Commons Attribution\n4.0 International License"), ("d/5", "")]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    named = {r["doc_id"]: r for r in licenses.scan(frame).collect()}
    assert (named[1]["status"], named[1]["licence"], named[1]["from_dir"]) == ("inherited", "MIT", "a")
    assert {named[i]["status"] for i in (3, 4, 6)} == {"none"}
    got = {r["doc_id"]: r for r in licenses.scan(frame, any_line=True).collect()}
    assert [(got[i]["status"], got[i]["licence"], got[i]["from_dir"]) for i in (1, 3, 4, 6)] == [
        ("inherited", "MIT", "a"), *[("inherited", "CC-BY-4.0", "b")] * 2, ("inherited", "CC-BY-4.0", "d")]
    assert all(got[i][c] == named[i][c] for i in (0, 2, 5) for c in ("status", "licence", "score"))


def test_op7_has_inherited_rows(spark):
    rows = queries.license_scan(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r["status"] == "inherited" for r in rows) > 0


def test_chat_links_orders_and_checks(spark):
    calls = [(1, 4, "b", "a", "search", '{"limit": 3, "query":"x"}'), (1, 2, "a", None, "annotate", '{"text":"t","strict":true,"weight":1.5,"z":1}'),
             (1, 9, "a", None, "search", "{}"), (1, 5, "c", "d", "search", '{"query":1}'), (1, 6, "d", "c", "nosuch", "{}"),
             (1, 7, "e", "gone", "search", "not json"), (None, 1, "n", None, "search", None), (1, 8, None, None, "search", '{"query":"q","limit":"3"}')]
    results = [(1, 8, "a", "late"), (1, 5, "b", "early"), (1, 6, "zz", "lost"), (1, 9, "a", "again"), (None, 2, "n", None)]
    messages = [(1, 0, "system", 'say "hi"\n'), (1, 1, None, None), (2, None, "user", "é")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    m = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = chat.format_calls(m, c, r).collect()
    assert len(got) == len(calls) + len(results) + len(messages)
    state = collections.Counter((x["kind"], x["call_id"], x["status"]) for x in got)
    assert state == collections.Counter([
        ("message", None, "ok"), ("message", None, "ok"), ("message", None, "ok"), ("call", "a", "unknown:z"), ("call", "b", "ok"), ("call", "a", "duplicate"),
        ("call", "c", "cycle"), ("call", "d", "cycle"), ("call", "e", "arguments:no object;open"), ("call", "n", "arguments:no object"),
        ("call", None, "type:limit;open"), ("result", "a", "linked"), ("result", "b", "linked"),
        ("result", "zz", "orphan"), ("result", "a", "duplicate"), ("result", "n", "linked")])
    place = {(x["kind"], x["call_id"], x["status"]): x["position"] for x in got if x["conv_id"] == 1}
    assert place["call", "a", "unknown:z"] < place["result", "a", "linked"] < place["call", "b", "ok"] < place["result", "b", "linked"]
    for conv in (1, 2, None):
        own = sorted(x["position"] for x in got if x["conv_id"] == conv)
        assert own == list(range(len(own)))
    for x in got:
        assert json.dumps(json.loads(x["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == x["json"]
    assert chat.format_calls(m.where("false"), c.where("false"), r.where("false")).count() == 0


def test_long_call_chain_keeps_its_order(spark):
    n = 70
    calls = spark.createDataFrame([(1, n - i, f"k{i:03}", f"k{i - 1:03}", "search", "{}") for i in range(n)], "conv_id long, turn long, call_id string, parent_id string, name string, arguments string")
    got = chat.format_calls(calls.select("conv_id", "turn", calls.name.alias("role"), calls.name.alias("text")).where("false"), calls,
                            calls.select("conv_id", "turn", "call_id", calls.name.alias("content"))).orderBy("position").collect()
    assert [x["call_id"] for x in got] == [f"k{i:03}" for i in range(n) for _ in range(2)]
    assert [x["kind"] for x in got] == ["call", "result"] * n


def test_chat_query_is_brute_force(spark):
    got = {(x["conv_id"], x["turn"]): x for x in queries.QUERIES["op9_chat_format"](spark, SF).collect()}
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    assert set(got) == set(turns)
    for (conv, turn), r in turns.items():
        text = r["text"]
        if r["role"] == "user":
            body = {"limit": len(text), "query": text} if turn % 4 == 0 else {"strict": len(text) % 2 == 0, "text": text}
            want = {"arguments": body, "id": f"c{conv}-{turn}", "name": "search" if turn % 4 == 0 else "annotate", "type": "call"}
        elif r["role"] == "assistant":
            want = {"content": text, "id": f"c{conv}-{turn - 1}", "type": "result"}
        else:
            want = {"content": text, "role": r["role"], "type": "message"}
        assert json.loads(got[conv, turn]["json"]) == want
        assert got[conv, turn]["position"] == sum(c == conv and t < turn for c, t in turns)


def test_pipeline_stages_take_effect(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = docs.collect()
        if name == "byte_bpe":
            assert sorted(r["doc_id"] for r in now) == sorted(r["doc_id"] for r in last)
            break
        assert docs.columns == columns and set(r["doc_id"] for r in now) <= set(before)
        if name in ("toxicity", "near_dedup"):
            assert all(before[r["doc_id"]]["text"] == r["text"] for r in now) and len({r["doc_id"] for r in now}) == len(now)
        if name == "line_dedup":
            assert len(now) == len(before)
            lines = [frozenset(word_list(x)) for r in now for x in r["text"].split("\n") if word_list(x)]
            assert len(lines) == len(set(lines)) and all(r["n_chars"] == len(r["text"]) for r in now)
        if name == "mixing":
            assert max(collections.Counter(r["doc_id"] for r in now).values()) <= 3
        before, last = {r["doc_id"]: r for r in now}, now


def test_near_copies_stage_keeps_one_of_each_group(spark, docs):
    plain = docs.select("doc_id", "text", "source")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, plain, SF).collect()]
    found = neardup.near_duplicates(plain, width=5).collect()
    assert sorted(x for x in kept if x is not None) == sorted({r["component_id"] for r in found if r["doc_id"] is not None})
    assert kept.count(None) == 1


def test_sources_name_no_engine_tricks():
    import inspect

    for module in (licenses, chat):
        assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas|pyarrow", inspect.getsource(module))
