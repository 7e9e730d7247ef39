"""BPE, line dedup, near-dedup, fingerprints and mixing against brute force."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from llm_fixtures import rows, shingles, word_list

from stockloom.llm import bpe, common, fingerprint, lines, mixing, neardup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def merge(word, ranks):
    """The merges by definition: the neighbouring pair of lowest rank first."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        best, at = min((ranks.get(pieces[i] + pieces[i + 1], 1 << 62), i) for i in range(len(pieces) - 1))
        if best == 1 << 62:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return [ranks[p] for p in pieces]


def test_word_hashes_tell_words_apart_and_ignore_case(monkeypatch):
    texts = [t or "" for _, t, _ in rows()]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, whole = common.hash_words(np.frombuffer(data, np.uint8), at)
    want = [w for t in texts for w in word_list(t)]
    assert len(whole) == len(want)
    assert len(set(zip(whole.tolist(), want))) == len(set(want)) == len(set(whole.tolist()))
    monkeypatch.setattr(common, "WINDOW", 64)
    _, windows = common.hash_words(np.frombuffer(data, np.uint8), at)
    assert (windows == whole).all()


def test_bpe_is_the_merges_and_round_trips(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert "source" in got[0].asDict() and len(got) == len(rows())
    texts = collections.Counter((i, t) for i, t, _ in rows())
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == texts
    for r in got:
        text = r["text"] or ""
        ids = [i for w in regex.findall(public_tokenizers.PATTERN, text) for i in merge(w.encode(), ranks)]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], bytes(r["token_ids"])) == (len(ids), hashlib.sha256(raw).hexdigest(), raw)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).select("text", "decoded").collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in decoded)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_line_dedup_is_brute_force(docs, empty):
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    seen, want, links = [], [], 0
    for i, text, _ in order:
        kept = []
        for line in [] if text is None else text.split("\n"):
            s = frozenset(word_list(line))
            if not s or not any(100 * len(s & t) >= 80 * len(s | t) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want.append((i, None if text is None else "\n".join(kept)))
    got = lines.dedup_lines(docs).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(want)
    assert all(r["lines_in"] >= r["lines_out"] for r in got) and sum(r["line_links"] for r in got) > 0
    assert {"source", "n_tokens"} <= set(got[0].asDict())
    assert lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_lines_of_large_families(spark, tmp_path, percent):
    """Families whose earliest member does not match all others, with rare words coming and going."""
    rng = random.Random(percent)
    common_words, out = [f"w{i}" for i in range(40)], []
    for family in range(6):
        base = rng.sample(common_words, 14) + [f"rare{family}x{j}" for j in range(4)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(common_words + [f"odd{rng.randrange(200)}"])
            out.append(" ".join(words[: rng.randint(14, 18)]))
    out += [" ".join(rng.sample(common_words, rng.randint(1, 6))) for _ in range(200)]
    rng.shuffle(out)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "\n".join(out[i * 4 : i * 4 + 4])) for i in range(140)], "doc_id long, text string").repartition(3).write.parquet(path)
    seen, want = [], {}
    for i in range(140):
        kept = []
        for line in out[i * 4 : i * 4 + 4]:
            s = frozenset(line.split())
            if not any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                kept.append(line)
            seen.append(s)
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.read.parquet(path), percent).collect()}
    assert got == want


@pytest.mark.parametrize("block", [1024, 16])
def test_links_of_a_family_follow_its_lines(spark, tmp_path, monkeypatch, block):
    """200 lines that nearly all match each other: no row for each pair, but every pair counted once."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:i] + [f"odd{k}"] + base[i + 1 :]) if k % 50 else " ".join(base[: 90 + k // 10]) for k in range(200) for i in [rng.randrange(120)]]
    sets = [frozenset(t.split()) for t in texts]
    want = [sum(s != t and 100 * len(s & t) >= 80 * len(s | t) for t in sets[:k]) for k, s in enumerate(sets)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    assert [r["line_links"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == want
    blocks = -(-200 // block)
    _, _, links = lines.matches(docs.selectExpr("doc_id as _row", "doc_id as _id", "text"))
    assert links.count() <= 200 * blocks < sum(want) and links.groupBy().sum("links").first()[0] == sum(want)


def test_one_python_worker_for_each_task_of_line_dedup(spark, tmp_path, capsys):
    """No Python node reads another one in the same stage, which would take two workers for each task."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"a b c d e f g h i j\nline {i}") for i in range(40)], "doc_id long, text string").write.parquet(path)
    lines.dedup_lines(spark.read.parquet(path)).explain()
    nodes = [n for n in re.findall(r"^[ :+*()\d-]*([A-Z]\w*)", capsys.readouterr().out, re.M) if re.search("Exchange|Arrow|Pandas", n)]
    assert nodes.count("MapInArrow") == 3
    assert not any("Exchange" not in a + b for a, b in zip(nodes[:2], nodes[1:]))


def test_rows_are_shuffled_packed(spark, tmp_path, capsys, monkeypatch):
    """Texts that lose lines cross the shuffle as compressed runs, whatever their size, and come back whole."""
    words = [f"w{i:03}" for i in range(300)]
    rng = random.Random(5)
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(300))]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["_row", "text"])
    packed = lines._packed(batch)
    assert lines._unpacked(packed).equals(batch) and len(packed) < 0.5 * sum(len(t or "") for t in texts)
    assert lines._unpacked(lines._packed(batch.slice(3, 4))).equals(batch.slice(3, 4))

    monkeypatch.setattr(lines, "RUN_BITS", 2)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"left {i}\nthe same line again\n\n{i} right", i % 3) for i in range(100)], "doc_id long, text string, other int").repartition(3).write.parquet(path)
    found = lines.dedup_lines(spark.read.parquet(path))
    found.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(run" in plan and "Join" not in plan
    got = {r["doc_id"]: (r["text"], r["other"], r["lines_in"], r["lines_out"], r["line_links"]) for r in found.collect()}
    assert got == {i: (f"left {i}\n" + "the same line again\n" * (i == 0) + f"\n{i} right", i % 3, 4, 3 + (i == 0), 0) for i in range(100)}


def test_rows_on_one_word_are_connected_alike(monkeypatch):
    """All pairs at once and row by row connect the same rows, with bitmaps of every width."""
    rng = np.random.default_rng(3)
    n = np.sort(rng.integers(1, 200, 400))
    few = [np.bitwise_and.reduce(rng.integers(0, 1 << 62, (4, 400), dtype=np.uint64)) for _ in range(4)]
    bits = [np.where(lines._parity_words(n) > k, b, np.uint64(0)) for k, b in enumerate(few)]
    got = []
    for group in (1, 50, 1000):
        monkeypatch.setattr(lines, "GROUP", group)
        pairs = list(lines._candidates(n, rng.integers(0, 1, 400), bits, np.array([0, 40, 300]), 80))
        node, least = lines._forest(*(np.concatenate(side) for side in zip(*pairs)))
        got.append(dict(zip(node.tolist(), least.tolist())))
    assert len(got[0]) > 50 and got[0] == got[1] == got[2]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_brute_force(docs, empty, width):
    sets = [(i, shingles(t, width)) for i, t, _ in rows() if i is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs, width).collect()
    want = collections.Counter((i, len(s), top(i), top(i) == i) for i, s in sets)
    assert collections.Counter(tuple(r) for r in got if r["doc_id"] is not None) == want
    (free,) = [r for r in got if r["doc_id"] is None]
    assert free["component_id"] is None and free["kept"]
    assert neardup.near_duplicates(empty, width).count() == 0


def test_near_duplicate_family_around_a_centre(spark, tmp_path):
    # Copies that are like the centre and not like each other, in blocks smaller than the family.
    words = [f"w{i}" for i in range(200)]
    texts = [words]
    for k in range(40):
        own = list(words)
        for p in range(8):
            own[(k * 5 + p * 23) % 200] = f"x{k}-{p}"
        texts.append(own)
    frame = spark.createDataFrame([(1000 - i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "d"))
    sets = {1000 - i: shingles(" ".join(t), 2) for i, t in enumerate(texts)}
    likes = sum(100 * len(sets[1000] & s) >= 80 * len(sets[1000] | s) for s in sets.values())
    got = neardup.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    sizes = collections.Counter(r["component_id"] for r in got)
    assert likes > 30 and max(sizes.values()) >= likes


def test_posterior_bound_keeps_true_pairs():
    least = neardup.least_matches()
    assert (np.diff(least) > 0).all()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (4000, neardup.ROWS * neardup.BANDS)).astype(np.uint16)
    at = lambda p: np.where(rng.random(a.shape) < p, a, a + np.uint16(1))
    assert len(neardup.survivors(a, at(0.8), least)) == 4000
    assert len(neardup.survivors(a, at(0.3), least)) == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100 and len(got) == 63
    assert common.components(links.where("false")).count() == 0


def test_components_of_random_graphs_and_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000, i) for i in range(900, 1100)] + [(-5, 2000 + i) for i in range(100)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: top(x) for x in root}


def test_fingerprints_follow_the_edit_rule(docs, empty):
    order = sorted(((i, t or "") for i, t, _ in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = collections.Counter()
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    got = fingerprint.edit_check(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[60] == prints[61] == prints[3] and prints[63] == prints[64] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["doc_id"]: r["near_next"] for r in got}[61] == 1.0  # the next document is its copy
    stored = fingerprint.fingerprints(docs).select("doc_id", "fingerprint").collect()
    assert {r["doc_id"]: r["fingerprint"] for r in stored} == prints
    assert fingerprint.edit_check(empty).count() == 0


def test_fingerprint_likeness_is_unbiased():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 64, 1200, dtype=np.uint64)
            both = int(share * 600)
            a, b = np.sort(pool[:600]), np.sort(np.concatenate((pool[:both], pool[600 : 600 + 600 - both])))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(fingerprint.likeness(fingerprint.bins_of(a), fingerprint.bins_of(b)) - true)
        assert abs(np.mean(errors)) < 0.02


def test_mixing_meets_targets(docs, empty):
    documents, stream = mixing.mix(docs)
    got = documents.collect()
    sizes = collections.Counter()
    for _, text, source in rows():
        sizes[source] += len(word_list(text))
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        new = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not new:
            break
        full |= new
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * total
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows()) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    served = stream.orderBy("position").collect()
    assert [r["position"] for r in served] == list(np.cumsum([0, *(r["served"] for r in served[:-1])]))
    assert all(x["finish"] <= y["finish"] for x, y in zip(served, served[1:]))
    again = mixing.mix(docs)[0].collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    assert mixing.mix(empty)[0].count() == 0
