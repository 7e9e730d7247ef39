"""Merkle manifest, vector codes and personal data against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_fixtures import rows

import stockloom.llm.queries as queries
from stockloom.llm import merkle, private, vectorcodes

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """(root, siblings of each node level by level as (left, right))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 16 * 16
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 16])))
            at[i] = p // 16
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(leaves):
    """(key, group, leaf, shown) rows to sorted (key, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for r in leaves:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = {g: plain_tree([r[2] for r in groups[g]]) for g in names}
    root, crowns = plain_tree([trees[g][0] for g in names])
    out = []
    for g, crown in zip(names, crowns):
        for r, path in zip(groups[g], trees[g][1]):
            node = r[3] or r[2]
            for a, b in path + crown:
                node = sha(a + node + b)
            out.append((r[0], r[2], trees[g][0], root, sha("".join(a + b for a, b in path + crown)), node, node == root))
    return sorted(out, key=repr)


FIELDS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_is_the_plain_tree(spark, levels):
    rng = random.Random(levels)
    made = []
    for group, n in ((None, 3), ("", 1), ("a", 700), ("é", 17), ("\U0001f600", 16), ("z", 257), *((f"g{i}", 1 + i % 4) for i in range(40))):
        made += [(rng.choice([i, i, None, 7]), group, sha(f"{group}{i // 2}"), sha("other") if i % 5 == 0 else None) for i in range(n)]
    rng.shuffle(made)
    frame = spark.createDataFrame([(*r, 1, 2) for r in made], "key long, name string, leaf string, shown string, place int, tree int").repartition(5)
    found = merkle.manifest(frame, "key", "name", "leaf", "shown", proofs=True, levels=levels).collect()
    # Rows of one key and hash are told apart by place alone, so they may trade what they show.
    steady = [r for r in plain_manifest(made)]
    got = sorted(((r["key"], *(r[c] for c in FIELDS)) for r in found), key=repr)
    assert [g[:5] for g in got] == [s[:5] for s in steady]
    assert sorted(g[6] for g in got) == sorted(s[6] for s in steady)
    for r in found:
        assert (merkle.folds([(p["left"], p["right"]) for p in r["proof"]], r["leaf"])) == r["root"]
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_manifest_of_odd_tables(spark, docs):
    leaves = docs.select("doc_id", "source", "n_tokens", merkle.leaf_hash("doc_id", "source", "text").alias("leaf"))
    one = leaves.where("doc_id = 5")
    r = merkle.manifest(one, "doc_id", "source", "leaf").collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == sha("")
    assert merkle.manifest(leaves.where("false"), "doc_id", "source", "leaf").collect() == []
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    plain = plain_manifest([(i, s, sha(field(i) + field(s) + field(t)), None) for i, t, s in rows()])
    got = sorted(((r["doc_id"], *(r[c] for c in FIELDS)) for r in merkle.manifest(leaves, "doc_id", "source", "leaf").collect()), key=repr)
    assert got == plain


def test_manifest_query_by_hand(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})

    def leaf(d, text):
        return sha("".join(map(field, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))))

    made = [(d["doc_id"], d["source"], leaf(d, d["text"]),
             leaf(d, d["text"] and d["text"].translate(lower)) if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 else None) for d in table]
    found = queries.QUERIES["op11_merkle_manifest"](spark, SF).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in FIELDS)) for r in found), key=repr) == plain_manifest(made)
    assert 0 < sum(not r["verified"] for r in found) < len(found) / 2


def plain_codes(table, parts=8, entries=16, rounds=6):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in table
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    wide = len(kept[0][2]) // parts
    cut = [[r[2][p * wide : (p + 1) * wide] for p in range(parts)] for r in kept]
    books = [[list(cut[r][p]) for r in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for c in cut:
                got.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, members in got.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    out, spent = [], {}
    for r, c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        spent[r[1]] = spent.get(r[1], 0) + out[-1][3]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((i, label, code, error, spent[label], digest) for i, label, code, error in out), key=repr)


def test_codes_are_plain_integer_kmeans(spark):
    rng = random.Random(3)
    table = [(i, [rng.uniform(-1, 1) * rng.choice([0.01, 1, 30]) for _ in range(24)], rng.choice([0, 1, None])) for i in range(160)]
    table += [(1000 + i, table[3][1], 1) for i in range(90)]  # copies
    table += [(200, None, 1), (201, [math.nan] * 24, 1), (202, [1.0] * 23 + [None], None), (203, [1.0] * 23 + [-math.inf], 0),
              (None, [0.5] * 24, 2), (4, [0.25] * 24, 2), (205, [0.0] * 24, 3), (-9, [-1e-9] * 24, 3)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in table], "vec_id long, embedding array<double>, label int, code string, key int").repartition(7)
    found, books = vectorcodes.compress(frame, "vec_id", "embedding", "label")
    got = sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()), key=repr)
    assert got == plain_codes(table)
    assert books.shape == (8, 16, 3)


def test_codes_of_odd_tables(spark):
    frame = spark.createDataFrame([(i, [float(i)] * 8, None) for i in range(5)], "vec_id long, embedding array<float>, label int")
    few, books = vectorcodes.compress(frame, "vec_id", "embedding", "label")
    assert books.shape == (8, 5, 1) and {r["error"] for r in few.collect()} == {0}
    assert vectorcodes.compress(frame.where("false"), "vec_id", "embedding", "label")[0].collect() == []
    odd = frame.union(spark.createDataFrame([(9, [1.0] * 16, 1), (10, [], 1), (11, [3e38] * 8, 1)], frame.schema))
    assert {r["vec_id"] for r in vectorcodes.compress(odd, "vec_id", "embedding", "label")[0].collect()} == set(range(5))
    long = spark.createDataFrame([(i, [math.sin(i * j) for j in range(2048)], i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
                  for r in vectorcodes.compress(long, "vec_id", "embedding", "label")[0].collect()), key=repr)
    assert got == plain_codes([(r["vec_id"], r["embedding"], r["label"]) for r in long.collect()])


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(o) <= 255 for o in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", "x@y", "@@", ".", "-", " ", "1", "25", "256", "255", "0", "+", "+1", "(", ")", "4111111111111111", "é", "\U0001f600", "\n", "%", "12.3.4.5"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert private.base_spans(text) == plain_base(text), text
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "1 " * 50_000, "+1(" + "-" * 100_000):
        assert len(private.base_spans(text)) >= 0  # in linear time
    assert private.base_spans("") == []


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(4)
    counts = {k: rng.integers(0, 9, (n, 5)).astype(float) for k, n in private._SIZES.items()}
    counts["skip"] += counts["skip"].T
    field = private.Field(counts)
    text = "call 5551234 or +49 (171) 5550134x or 71.5551234 now a@b.de"
    g = private.Graph(text)
    g.label = [3 if i == 1 else 0 for i in range(len(g.spans))]
    own = field.prior + field.form[g.form] + 0.5 * field.made[g.made] + 0.5 * field.word[g.word]
    pairs = {}
    for i, key in enumerate(g.keys):
        if key >= 0:
            pairs.setdefault(key, []).append(i)
    hubs = [m for m in pairs.values() if len(m) > 1]
    assert len(hubs) == 1 and len(g.chain) >= 2
    want = np.zeros((len(g.spans), 5))
    for labels in itertools.product(range(5), repeat=len(g.spans)):
        if any(seen and labels[i] != seen for i, seen in enumerate(g.label)):
            continue
        # Observed tokens have no potential of their own.
        w = math.exp(sum(0.0 if g.label[i] else own[i, x] for i, x in enumerate(labels)) + sum(field.chain[labels[i], labels[i + 1]] for i in g.chain))
        for m in hubs:
            w *= sum(math.exp(sum(field.skip[labels[i], h] for i in m)) for h in range(5))
        for i, x in enumerate(labels):
            want[i, x] += w
    want /= want.sum(1, keepdims=True)
    alone = private.posteriors(field, [g], rounds=60)
    assert alone == pytest.approx(want, abs=1e-6)
    other = private.Graph("x@y.com 4111111111111111")
    assert np.array_equal(private.posteriors(field, [other, g], rounds=60)[len(other.spans) :], alone)


def planted():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def card():
        while True:
            n = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if private.luhn(n):
                return n

    out = []
    for i in range(400):
        area, rest = f"({rng.randint(200, 999)})", f"{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        words = [word() for _ in range(12)] + ["+1", area, rest, word(), ip, word(), card(), word(), f"{word()}@{word()}.com", word()]
        out.append((i, " ".join(words)))
    a, b = card(), card()
    out.append((1000, f"pay {a} or {a} {b} please"))  # two cards that run into each other, one of them told
    out.append((1001, "ring +1 (212) 555-0187 then again (212) 555-0187 today"))
    out.append((1002, "order 4111111111111112 of 999.1.1.1 and 12 of 2021"))  # fails the checks
    out += [(1003, None), (1004, ""), (1005, "plain words only"), (None, "mail me at a.b@c.org"), (1004, "")]
    return out


def test_field_adds_what_patterns_miss(spark):
    made = planted()
    frame = spark.createDataFrame([(*r, "b", "k") for r in made], "doc_id long, text string, base string, kind string").repartition(3)
    field = private.fit(frame)
    found = private.find(frame, field)
    assert found.columns == ["doc_id", "text", "kind", "base", "added"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(made)
    for i, text in made:
        assert [(s["start"], private.KINDS.index(s["kind"]), s["end"]) for s in got[i]["base"]] == plain_base(text or "")
    added = {i: [(s["kind"], got[i]["text"][s["start"] : s["end"]]) for s in got[i]["added"]] for i in got}
    assert [k for k, _ in added[1000]] == ["card", "card"] and " ".join(x for _, x in added[1000]) in got[1000]["text"]
    assert added[1001] == [("phone", "(212) 555-0187")]
    assert all(not added[i] for i in added if i not in (1000, 1001))
    text = found.select(private.joined(found["base"]).alias("s")).where("doc_id is null").first()["s"]
    assert text == "email:11:20"
    assert private.find(frame.where("false"), private.fit(frame.where("false"))).collect() == []
    again = {r["doc_id"]: r["added"] for r in private.find(frame.repartition(11), field).collect()}
    assert all(again[i] == got[i]["added"] for i in again)


def test_personal_data_query(spark):
    table = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    found = queries.QUERIES["op13_personal_data"](spark, SF).collect()
    assert len(found) == len(table)
    for r in found:
        base = plain_base(table[r["doc_id"]])
        listed = [f"{private.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == sha(",".join(listed))
        assert [r[f"n_{k}"] for k in private.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans) and len(spans) == len(base) + r["n_added"]
