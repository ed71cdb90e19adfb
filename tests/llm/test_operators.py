"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkplan.llm import chat, decontaminate, embeddings, jaccard, langid, lines, mixing, secrets, tokens, warc
from inkplan.llm.components import components

LONG = "lorem ipsum " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def classes(nodes, links):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


# --- components -----------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    want = classes(range(500), links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_embeddings_of_one_id(spark):
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1]
    rows = [(7, a, 1), (8, a, 1), (7, b, 1), (9, b, 1), (3, [0.01, 1.0, 0.1], 1), (4, a, 2)]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(3, 2, 3, True), (4, 0, 4, True), (7, 1, 7, True), (7, 2, 3, False), (8, 1, 7, False), (9, 2, 3, False)]


def brute_embeddings(rows, threshold=0.98):
    good = [(i, r) for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links = []
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if x[2] == y[2] and len(x[1]) == len(y[1]):
                p, q = np.array(x[1]), np.array(y[1])
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                    links.append((i, j))
    count = Counter(k for l in links for k in l)
    low = classes(range(len(rows)), links)
    comp = defaultdict(list)
    for i, r in enumerate(rows):
        comp[low[i]].append(r[0])
    return sorted((r[0] is not None, r[0] or 0, count[i], min(v for v in comp[low[i]] if v is not None) if r[0] is not None else None) for i, r in enumerate(rows))


@pytest.mark.parametrize("tile", [3, 512])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 16))
    rows = [(100 + i, (centers[i % 6] + rng.normal(size=16) * 0.06 * (i % 3)).astype(np.float32).tolist(), i % 2) for i in range(60)]
    rows += [(7, rows[0][1], 0), (8, rows[0][1], 0), (9, [2 * v for v in rows[0][1]], 0), (1, None, 0), (2, [0.0] * 16, 0), (3, [1.0] * 15 + [None], 0), (4, [float("nan")] * 16, 0), (5, [1.0, 2.0], 0), (6, [2.0, 4.0], 0), (10, rows[0][1], None), (None, rows[0][1], 0), (11, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == brute_embeddings(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_comparison_stops_early_and_loses_nothing():
    rng = np.random.default_rng(0)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(50, 24)), rng.normal(size=(40, 24))))
    y[:5] = x[:5] + 0.01
    for t in (0.2, 0.9, 0.98):
        a, b = embeddings.compare(x.astype(np.float32), y.astype(np.float32), x, y, t)
        exact = x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(exact >= t).tolist()))


# --- 2 ----------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, gone = set(), defaultdict(set)
    for d, t in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = t.split("\n")
        for i in range(max(1, len(ls) - 2)):
            w = tuple(ls[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone[d, t] |= {i, i + 1, i + 2} & set(range(len(ls)))
            seen.add(w)
    return sorted(((d is not None, d or 0, 0 if t is None else len(t.split("\n")), len(gone[d, t]), t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in rows), key=str)


def test_lines(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "q\nr\ns"), (104, "q\nr\ns"), (None, "q\nr\ns\nt"), (105, LONG + "\nx\ny\n" + LONG + "\nx\ny")]
    rows += [(106, "one line"), (107, "one line"), (108, "two\nlines"), (109, "two\nlines"), (110, "two\nlines\nand more"), (111, " \n"), (112, " \n"), (113, "one line\n")]
    out = lines.dedup_lines(docs(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, row int, at int"))
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_removed, r.text) for r in out.collect()), key=str) == brute_lines(rows)
    assert lines.dedup_lines(docs(spark, [])).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\[/INST]", "[/INST", "<s:1>", "[INST user]\nx[/INST]", "[OUT]\n</s>", "", None, "a\nb", "é€😀</s>", "[\\/INST]", "<", LONG]
    roles = ["user", "assistant", "system", "we]ird\nrole +%", None, ""]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 1, "user", "x"), (99, None, "assistant", "first"), (99, 1, "assistant", None)]
    out = chat.format_conversations(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, source string"))
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-(1 << 63) if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == {c: [v[1:] for v in sorted(vs)] for c, vs in want.items()}
    for d in chat.digests(out).collect():
        turns = got[d.conv_id].turns
        loss = "".join(t.text for t in turns if t.role == "assistant")
        assert (d.n_turns, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(got[d.conv_id].formatted))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in turns).encode()).hexdigest()
    marks = re.compile(r"\[/?INST|\[OUT\]|</s>|<s:")
    for r in got.values():
        bodies = re.sub(r"^<s:\d>", "", r.formatted)
        assert len(marks.findall(bodies)) == sum(1 if t.role == "assistant" else 2 for t in r.turns) + sum(t.role == "assistant" for t in r.turns)
        under = [r.formatted[s.first : s.past] for s in r.loss]
        assert (under if r.formatted.startswith("<s:0>") else [re.sub(r"(?s)\\(.)", r"\1", u) for u in under]) == [t.text for t in r.turns if t.role == "assistant"]
    held = spark.createDataFrame([(1, 0, "user", "a </s> b [INST x]"), (1, 1, "assistant", "ok [/INST] [INST user]\nhi")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(held).first().formatted == "<s:1>[INST user]\na <\\/s> b [\\INST x][/INST][OUT]\nok [\\/INST] [\\INST user]\nhi</s>"
    plain = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(plain).first().formatted == "<s:0>[INST user]\nhi[/INST][OUT]\nyo</s>"
    assert chat.format_conversations(plain.limit(0)).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        target = {s: cap * sizes[s] if s in capped else left * w[s] / share for s in names}
        new = {s for s in names if s not in capped and target[s] > cap * sizes[s]}
        if not new:
            return target
        capped |= new


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), None, f"s{rng.choice([0, 0, 0, 1, 2, 3])}", 1) for i in range(300)]
    rows += [(1000, None, None, "s1", 0), (1001, " \t\n", None, "s1", 0), (1002, "a b\xa0c", None, None, 0), (1003, LONG, None, "Zé", 0), (1002, "a b\xa0c", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in out) == sorted((r[0], size(r[1])) for r in rows)
    taken = Counter()
    for r in out:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        # the nearest sum that up to three copies of each document reach
        reach = 1
        for r in rows:
            for _ in range(3 if r[3] == s else 0):
                reach |= reach << size(r[1])
        goal = round(want[s])
        off = next(d for d in range(goal + 1) if reach >> (goal - d) & 1 or reach >> (goal + d) & 1)
        assert abs(taken[s] - goal) == off, s
    assert sorted(out, key=str) == sorted(mixing.mix(df.repartition(7)).collect(), key=str)
    copies = Counter((r.doc_id, r.text) for r in mixing.mixture(df).collect())
    assert sum(size(t) * n for (_, t), n in copies.items()) == sum(taken.values())
    assert mixing.mixture(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0 and mixing.targets(df.limit(0).select("source", F.lit(1).alias("size"))).count() == 0
    clash = df.withColumn("mix_h", F.lit(1)).withColumn("h", F.lit(2))
    assert mixing.mixture(clash).columns == clash.columns and mixing.mixture(clash).count() == sum(copies.values())


def test_targets_of_many_sources(spark):
    rng = random.Random(40)
    sizes = {None: 900, **{f"host{rng.randrange(10**6)}": int(10 ** rng.uniform(0, 5)) for _ in range(500)}}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_fit_of_long_documents():
    fit = lambda l, c, b: int((mixing.fit_counts(np.array(l), np.array(c), b) * l).sum())
    assert fit([100000], [3], 190000) == 200000 and fit([70000, 90000], [3, 3], 250000) == 250000 and fit([100000], [3], 60000) == 100000
    rng = np.random.default_rng(9)
    lengths = np.unique(np.concatenate([rng.integers(1, 3000, 400), rng.integers(100_000, 1_000_000, 40)]))
    counts = rng.integers(1, 2000, len(lengths))
    total = int((lengths * counts).sum())
    for part in (0.1, 0.5, 0.93):
        assert fit(lengths, counts, int(total * part)) == int(total * part)
    # sums of two lengths alone are sparse until many of them are freed
    assert fit([997, 1009], [5000, 5000], 3_000_001) == 3_000_001


@pytest.mark.parametrize("seed", range(20))
def test_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 40, 12))
    counts = rng.integers(1, 5, len(lengths))
    budget = int(rng.integers(0, (lengths * counts).sum() + 1))
    take = mixing.fit_counts(lengths, counts, budget, seed)
    reach = {0}
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        reach = {r + k * n for r in reach for k in range(c + 1)}
    assert (take >= 0).all() and (take <= counts).all()
    assert int((take * lengths).sum()) == min(reach, key=lambda r: (abs(r - budget), r))


# --- 5 ----------------------------------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


@pytest.mark.parametrize(("k", "num", "den", "common"), [(3, 9, 10, 64), (5, 8, 10, 3)])
def test_jaccard(spark, k, num, den, common):
    rng = random.Random(k)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([2, 4, 30, 80, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own).replace("a", rng.choice("aA"))))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "é É"), (906, "é é"), (907, rows[5][1]), (None, rows[5][1]), (908, LONG), (909, LONG + "end"), (910, rows[7][1]), (910, rows[7][1])]
    sets = {d: shingle_set(t, k) for d, t in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    low = classes(ids, links)
    out = jaccard.jaccard_classes(docs(spark, [(*r, 5, 6) for r in rows], "doc_id long, text string, n int, token int"), k, num, den, common).collect()
    want = sorted((d is not None, d or 0, len(shingle_set(t, k)), low[d] if d is not None else None) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in out) == want


def test_jaccard_prefixes_without_crowded_shingles(spark):
    # a sketch that finds nothing frequent, as one of a very large input
    rows = [(i, " ".join([*(f"all{j}" for j in range(40)), *(f"w{i}x{j}" for j in range(60))])) for i in range(80)]
    given, flat = docs(spark, rows).repartition(3), np.zeros(1 << jaccard.SKETCH_BITS, np.float32)
    before = jaccard._counted(jaccard._names(jaccard._prefixes(given, 3, 9, 10, flat))).cache()
    assert before.where("sets >= 8").count() > 0
    crowded = jaccard.IdFilter(before, "token", before.count())
    names = jaccard._names(jaccard._prefixes(given, 3, 9, 10, flat, crowded))
    assert names.count() == 80 and jaccard._counted(names).join(before, "token", "left_semi").count() == 0


def test_jaccard_tiles_in_rounds(spark, tmp_path):
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 60, 40)
    sets = [np.sort(rng.choice(pool, 36, replace=False)) for _ in range(24)]
    parts = [sets[i : i + 4] for i in range(0, 24, 4)]
    raw = lambda x: np.asarray(x, np.int64).tobytes()
    rows = [(t, raw(range(4 * t, 4 * t + 4)), raw([len(x) for x in own]), b"".join(map(raw, own))) for t, own in enumerate(parts)]
    tiles = spark.createDataFrame([(t, labels, sizes, hashes) for t, labels, sizes, hashes in rows], "tile long, labels binary, sizes binary, hashes binary")
    met = spark.createDataFrame([(a, b) for a in range(6) for b in range(a, 6)], "tile1 long, tile2 long")
    found = [{tuple(r) for r in jaccard._spans(met, tiles, 8, 10, f"file://{tmp_path}/{laid}", laid).collect()} for laid in (1, 1 << 30)]
    assert found[0] == found[1] and found[0]
    assert len(list((tmp_path / "1").iterdir())) > 1 and len(list((tmp_path / str(1 << 30)).iterdir())) == 1


def test_jaccard_of_one_group(spark):
    """A large group of near copies around one text, sets with one common passage, and a chain that only its neighbours link."""
    rng = random.Random(50)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(900))
    base, passage, chain = [word() for _ in range(120)], [word() for _ in range(40)], [word() for _ in range(400)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.005, 0.02]) else word() for w in base)) for i in range(150)]
    rows += [(200 + i, " ".join(passage + [word() for _ in range(rng.choice([2, 4, 30]))])) for i in range(150)]
    rows += [(400 + i, " ".join(chain[3 * i : 3 * i + 100])) for i in range(90)]
    rows += [(3, rows[200][1]), (700, rows[3][1]), (700, rows[3][1] + " more")]
    sets = [(d, shingle_set(t, 5)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if a == b or 10 * len(x & y) >= 8 * len(x | y)]
    low = classes(sorted({d for d, _ in rows}), links)
    out = jaccard.jaccard_classes(docs(spark, rows), 5, 8, 10, 4).collect()
    assert sorted(map(tuple, out)) == sorted((d, len(s), low[d]) for d, s in sets)


def test_shingles_of_few_words():
    """Batches that hold fewer words than a shingle, and rows around its length."""
    import pyarrow as pa

    from inkplan.llm.common import Words, shingles

    for texts in ([], [None], [""], ["a"], ["a b"], ["a b c"], ["a", "b c", "", "d"], ["a b c d e", "a b", "a b c d e f", "A B"]):
        for k in (1, 3, 5):
            h, row = shingles(Words(pa.array(texts, pa.string())), k)
            want = []
            for i, t in enumerate(texts):
                w = (t or "").lower().split()
                want += [(i, tuple(w))] if 0 < len(w) < k else [(i, tuple(w[j : j + k])) for j in range(len(w) - k + 1)]
            assert row.tolist() == [i for i, _ in want] and len(set(h.tolist())) == len({s for _, s in want})


def test_tallies_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for n, m, common in ((0, 9, 0), (30, 25, 20), (900, 1000, 700), (5, 4000, 5)):
        every = rng.integers(0, 1 << 64, n + m, np.uint64, endpoint=False)
        x, y = np.sort(every[:n]), np.sort(every[n - common : n - common + m])
        shared = len(np.intersect1d(x, y))
        assert shared <= jaccard.most_shared(jaccard.tally(x), jaccard.tally(y))
    same = jaccard.tally(np.arange(5000, dtype=np.uint64))
    assert jaccard.most_shared(same, same) >= 5000


def test_one_of_each(spark):
    text = " ".join(map(str, range(60)))
    rows = [(5, text), (3, text + " x"), (3, text + " x"), (9, "other words here"), (9, "and more"), (None, text)]
    given = docs(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, mark int, _mark_id int")
    out = jaccard.one_of_each(given)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (True, 3), (True, 9), (True, 9)] and out.schema == given.schema
    assert jaccard.one_of_each(given.limit(0)).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forest(spark):
    """A lexicon of invented prose, and the forest for the built-in findings."""
    rng = random.Random(60)
    words = [a + b for a in "ba du ke li mo na ri so ta wu the ing hou sch ver".split() for b in "len ster nung ters word sing tion mer".split()]
    words = secrets.lexicon(docs(spark, [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(60)]))
    return secrets.train(secrets.labelled_findings(spark, words), words), words


def test_secrets(spark, forest):
    hexes = hashlib.sha256(b"x").hexdigest()
    texts = {
        1: f'set token = "{hexes[:40]}" here', 2: f"in AKIA{'Q7' * 8} on", 3: f"that password={hexes[:18]} is", 4: f"the commit {hexes[:40]} was", 5: "see /usr/share/doc/package/index2/file1.html and",
        6: "mail first.last12345@mail3.example.com now", 7: f"md5 {hexes[:32]} of", 8: None, 9: "", 10: "plain words " * 5000, 11: "uuid 123e4567-e89b-42d3-a456-426614174000 was",
        12: "password=hunter2abc99", 13: "now password=correcthorsebatterystaple is", 14: LONG + "api_key = 'zq81hdk2mx0' " + LONG, None: f"that password={hexes[:18]} is",
    }
    rows = [(d, t, 1, "p", 2.0) for d, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, size int, value string, pairs double")
    found = secrets.scan(df, *forest)
    assert not any(w in found._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
    want = {1: hexes[:40], 2: "AKIA" + "Q7" * 8, 3: hexes[:18], 12: "hunter2abc99", 13: "correcthorsebatterystaple", 14: "zq81hdk2mx0", None: hexes[:18]}
    assert sorted(((r.doc_id, r.value) for r in found.collect()), key=str) == sorted([*want.items(), (3, hexes[:18])], key=str)
    assert secrets.scan(df.limit(0), *forest).count() == 0
    assert len(set(secrets.lexicon(df.limit(0)).pairs)) == 1


def test_secrets_within_a_word(spark, forest):
    one, two = hashlib.sha256(b"y").hexdigest()[:40], hashlib.sha256(b"z").hexdigest()[:40]
    key = "wJalrXUtnFEMI/K7MDENGbPxRfiCYEXAMPLEKEY"
    texts = {
        1: f"AWS_SECRET_ACCESS_KEY={key}", 2: f'{{"password":"{one}","token":"{two}"}}', 3: f"https://www.example.com/user/service/config/index-page?token={one}",
        4: f"password={one};api_key={two}", 5: f'say {{"long_access_token_name":"{one}"}} is', 6: "see https://www.example.com/user/service-manager/index?page=/home/local/share/file-index-2 and",
    }
    df = docs(spark, list(texts.items()))
    every = sorted((r.doc_id, r.value) for r in secrets.candidates(df).collect())
    assert every == sorted((d, v) for d, t in texts.items() for v in re.findall(r"[A-Za-z0-9_+/\-]{16,}", t))
    found = {(r.doc_id, r.value) for r in secrets.scan(df, *forest).collect()}
    want = {(1, key), (2, one), (2, two), (3, one), (4, one), (4, two), (5, one)}
    # a name in capitals may be taken for a key, as it may be without a value beside it
    assert want <= found <= want | {(1, "AWS_SECRET_ACCESS_KEY")}


def test_secrets_of_other_kinds(spark, forest):
    """Findings that no built-in template makes: precision and recall of 0.9."""
    rng = random.Random(61)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    mixed, hexes, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    words = ["render", "status", "account", "window", "parser", "module", "invoice", "street", "number", "switch"]
    name = lambda sep, n: sep.join(rng.choice(words) for _ in range(n))
    good = [
        lambda: (f"slack xoxb-{some('0123456789', 12)}-{some(mixed, 24)} used", 24), lambda: (f"maps AIza{some(mixed, 35)} there", 35), lambda: (f"DB_PASSWORD={some(mixed, 14)}", 14), lambda: (f"client_secret: '{some(mixed, 32)}'", 32),
        lambda: (f'"auth_token": "{some(hexes, 64)}",', 64), lambda: (f"export API_KEY={some(mixed, 28)}", 28), lambda: (f"glpat-{some(mixed, 20)} in the file", 20), lambda: (f"passwd = {some(low, 5)}{some('0123456789', 4)}", 9),
    ]
    bad = [
        lambda: f"commit {some(hexes, 40)} by someone", lambda: f"sha256:{some(hexes, 64)} image", lambda: f"import com.example.{name('.', 4)}.V2Factory", lambda: f"class={name('-', 4)}-2 of it", lambda: f"https://example.org/{name('/', 4)}/p{some('0123456789', 4)}",
        lambda: f"the {name('_', 4)}_v{some('0123456789', 2)} was", lambda: f"password: {rng.choice(words)}s are kept", lambda: f"trace id {some(hexes, 8)}-{some(hexes, 4)}-4{some(hexes, 3)}-a{some(hexes, 3)}-{some(hexes, 12)} of", lambda: f"at 2024-0{rng.randrange(1, 9)}-11T10:11:{rng.randrange(10, 59)}.{some('0123456789', 6)}Z on",
        lambda: f"/opt/{name('/', 3)}/lib{some('0123456789', 2)}/{name('-', 2)}.so",
    ]
    rows, secret = [], set()
    for i in range(640):
        rows.append((i, rng.choice(good)()[0] if i % 2 else rng.choice(bad)()))
        if i % 2:
            secret.add(i)
    found = {r.doc_id for r in secrets.scan(docs(spark, rows), *forest).collect()}
    precision, recall = len(found & secret) / len(found), len(found & secret) / len(secret)
    print("precision", precision, "recall", recall)
    wrong = [rows[i][1] for i in sorted(found ^ secret)][:30]
    assert precision >= 0.9 and recall >= 0.9, (precision, recall, wrong)


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [(i, f"http://x/{i}\r\n", f"<p>{i % 4}</p>" * (i % 5)) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "é", LONG), (53, "é", LONG), (None, "n", LONG), (3, "again", "<p>3</p>" * 3), (1, "x", "one"), (1, "x", "one"), (1, "w", "one"), (None, "x", "one"), (None, "a", "none"), (None, "a", "none"), (None, None, "none")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int")
    files = warc.write_archives(df, f"file://{tmp_path}/a", archive_bytes=300)
    got = sorted(((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files).collect()), key=str)
    # the response of each payload: its least page, null last, then the least url
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    want, seen = [], {}
    for p, _, h in sorted(pages, key=order):
        data = (h or "").encode()
        again, first = (h or "") in seen, seen.setdefault(h or "", p)
        want.append((p is not None, p or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    every = warc.read_archives(files, payload=True).collect()
    assert len({r.record_id for r in every}) == len(pages) and {r.refers_to_id for r in every if r.refers_to_id} <= {r.record_id for r in every if r.record_type == "response"}
    payloads = {r.page_id: bytes(r.html) for r in warc.read_archives(files, payload=True).collect() if r.html is not None and r.page_id is not None}
    assert all((h or "").encode() == payloads[p] for p, _, h in pages if p in payloads and p not in (1, 3))
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    kept = warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/b", least_bytes=20)).collect()
    assert all(r.payload_bytes >= 20 for r in kept if r.record_type == "revisit")


def test_archives_of_other_writers(spark, tmp_path):
    import struct

    import zstandard

    def made(kind, block, media, version="WARC/1.1", **fields):
        head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{len(records)}>", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Type: {media}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())]
        records.append("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n")

    records: list[bytes] = []
    body = "<p>häuser</p>".encode()
    made("warcinfo", b"software: other\r\n", "application/warc-fields", "WARC/1.0")
    made("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "application/http; msgtype=request")
    made("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, "application/http; msgtype=response", WARC_Target_URI="http://x/", WARC_Payload_Digest=f"sha256:{hashlib.sha256(body).hexdigest()}")
    made("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n" + body, "application/http;msgtype=response", "WARC/1.0")
    made("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "application/http; msgtype=response", WARC_Refers_To="<urn:uuid:2>", WARC_Payload_Digest="blake3:xyz")
    made("metadata", b"a: b\r\n", "application/warc-fields")
    made("resource", b"text", "text/plain")
    made("response", b"20240101 x 60 IN A 1.2.3.4", "text/dns")
    words = warc.dictionary([r * 9 for r in records])
    kind = zstandard.ZstdCompressionDict(words)

    def frame(data, **options):
        pack = zstandard.ZstdCompressor(**options).compressobj()
        return pack.compress(data) + pack.flush()

    packed = zstandard.ZstdCompressor().compress(words)
    skippable = struct.pack("<II", 0x184D2A53, 5) + b"other"
    archives = {
        "plain": struct.pack("<II", warc.SKIPPABLE_MAGIC, len(words)) + words + b"".join(frame(r, dict_data=kind, write_content_size=False) for r in records),
        "packed": struct.pack("<II", warc.SKIPPABLE_MAGIC, len(packed)) + packed + skippable.join(frame(r, dict_data=kind, write_checksum=True) for r in records), "without": b"".join(frame(r) for r in records),
    }
    for name, data in archives.items():
        assert list(warc.read_archive(data)) == records, name
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/{name}",) for name in archives], "uri string")
    rows = warc.read_archives(files, payload=True).collect()
    assert Counter(r.record_type for r in rows) == {"response": 9, "revisit": 3} and all(r.page_id is None for r in rows)
    assert Counter(bytes(r.html) for r in rows if r.html is not None)[body] == 6 and {r.payload_digest for r in rows if r.record_type == "revisit"} == {"xyz"}
    assert warc.read_archives(files, types=()).count() == 24
    wrong = records[2].replace(b"h\xc3\xa4user", b"h\xc3\xa4usee")
    with pytest.raises(warc.WarcError):
        warc.parse_record(wrong)


def test_broken_archives():
    good = warc.write_archive([warc.record(str(i), "u", b"x" * 50, None, "2020-01-01T00:00:00Z") for i in range(5)], warc.dictionary([b"few"]))
    assert len([warc.parse_record(r) for r in warc.read_archive(good)]) == 5
    for bad in (good[8:], good[:-3], b"", good[:100] + b"\0\0" + good[102:]):
        with pytest.raises(warc.WarcError):
            [warc.parse_record(r) for r in warc.read_archive(bad)]
    whole = warc.record("1", "u", b"payload", None, "d")
    for bad in (whole.replace(b"payload", b"paylaad"), whole[:-1], whole.replace(b"WARC/1.1", b"WARC/9"), whole.replace(b"Content-Length: 7", b"Content-Length: 8"), whole.replace(b"WARC-Date: d\r\n", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# --- 8 ----------------------------------------------------------------------------------------------------------------


def brute_overlap(text, item):
    """Whether some diagonal has a stretch that meets the limits: every stretch of every diagonal is looked at."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    x, y = words(text), words(item)
    n = len(y)
    need = 12 if n > 12 else min(-(-85 * n // 100), n - 1) if n >= 6 else n
    if n < decontaminate.SHORTEST:
        return False
    for d in range(-n, len(x)):
        same = [0 <= d + i < len(x) and x[d + i] == y[i] for i in range(n)]
        total = [0]
        for s in same:
            total.append(total[-1] + s)
        for a in range(n):
            for b in range(a + 1, n + 1):
                equal = total[b] - total[a]
                if equal >= need and equal >= 0.75 * (b - a):
                    return True
    return False


def test_decontamination_against_all_stretches(spark):
    """Substitutions only: all that is found is there, and of what is there with a hit of a mask nothing is missed."""
    rng = random.Random(81)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 4, 5, 6, 6, 7, 8, 9, 10, 12, 16, 30])))) for i in range(60)]
    rows = []
    for d in range(160):
        own = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            own[rng.randrange(len(own))] = word()
        rows.append((d, " ".join([word() for _ in range(rng.randrange(15))] + own + [word() for _ in range(rng.randrange(15))])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in rows for i, x in items if brute_overlap(t, x)}
    assert found == want


def test_items_with_a_common_opening():
    """Thousands of items that begin alike, in a text that repeats the beginning: quick, and nothing found."""
    import time

    import pyarrow as pa

    rng = random.Random(82)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    opening = [word() for _ in range(6)]
    items = [" ".join(opening + [word() for _ in range(20)]) for _ in range(3000)]
    text = " ".join(sum(([*opening, word(), word()] for _ in range(300)), []))
    start, found = time.time(), 0
    for a in range(0, len(items), decontaminate.TOGETHER):
        found += len(decontaminate.Benchmark(items[a : a + decontaminate.TOGETHER]).find(pa.array([text]))["row"])
    print("seconds", time.time() - start)
    assert found == 0 and time.time() - start < 20
    assert len(decontaminate.Benchmark(items[:256]).find(pa.array([f"{text} {items[7]} {text}"]))["row"]) == 1


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(14, 60)))) for i in range(20)] + [(90, None), (91, ""), (92, "two words"), (93, "five short words stand here"), (94, "five short words stand here"), (95, "one single word stands for it"), (96, "three words here")]
    rows, want = [], set()
    for d in range(200):
        text = [word() for _ in range(rng.randrange(5, 120))]
        if d % 4 == 0:
            i, item = items[d // 4 % 20]
            own = item.split()
            if d % 8:
                own = [w if k % 6 else word() for k, w in enumerate(own)]
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," for w in own]
            want.add((d, i))
        rows.append((d, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "x Five short, words stand HERE y"), (504, "two words"), (505, "here one other word stands for it all"), (505, "here one other word stands for it all"), (None, items[3][1]), (503, LONG + items[4][1])]
    df, bench = docs(spark, [(*r, 1) for r in rows], "doc_id long, text string, start int"), spark.createDataFrame(items, "item_id long, text string")
    want |= {(502, 93), (502, 94), (505, 95), (None, 3), (503, 4)}
    for together in (256, 2):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
        assert got == want
    given = df.withColumn("name", F.lit(1)).withColumn("item", F.lit(2))
    clean = decontaminate.without_overlaps(given, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and clean.columns == given.columns
    assert decontaminate.overlaps(df, bench.limit(0)).count() == 0 and decontaminate.overlaps(df.limit(0), bench).count() == 0


def test_decontamination_of_parts(spark):
    rng = random.Random(80)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    sizes = (150, 400, 16, 20, 8, 1000)
    items = [[word() for _ in range(n)] for n in sizes]
    other = lambda n: [word() for _ in range(n)]
    long, longer, short, middle, least, most = items
    texts = {
        1: (long[40:90], 0), 2: (longer[200:300], 1), 3: (longer[50:62], 1), 4: (short[:8] + other(1) + short[8:], 2), 5: (short[:8] + short[9:], 2), 6: (middle[:6] + other(1) + middle[6:13] + middle[14:], 3),
        7: (long[:9] + other(2) + long[9:20], 0), 8: (least[:4] + least[4:], 4), 9: (most[700:713], 5), 10: (sum(([*most[i : i + 5], *other(2)] for i in range(0, 140, 7)), []) + most[140:152], 5),
        20: (long[:11], None), 21: (long[:6] + other(9) + long[15:20], None), 22: (short[:5] + other(30) + short[5:], None), 23: (middle[10:] + middle[:10], None),
    }
    rows = [(d, " ".join(other(20) + own + other(20))) for d, (own, _) in texts.items()]
    df, bench = docs(spark, rows), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = {(d, i) for d, (_, i) in texts.items() if i is not None}
    found = decontaminate.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    at = {r.doc_id: (r.start, r.n_words, r.n_equal) for r in found}
    assert (at[1], at[2], at[3], at[4], at[5], at[6], at[7]) == ((20, 50, 50), (20, 100, 100), (20, 12, 12), (20, 17, 16), (20, 15, 15), (20, 20, 19), (20, 22, 20))
    assert {r.doc_id for r in decontaminate.without_overlaps(df, bench).collect()} == {d for d, (_, i) in texts.items() if i is None}


# --- 9 ----------------------------------------------------------------------------------------------------------------


def test_tokens(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(5, "Hello, it's 42 × naïve!"), (1, None), (3, ""), (2, "日本 İstanbul <|endoftext|> \xa0x"), (4, LONG), (9, "tie"), (9, "tie"), (None, "no id"), (-4, "***?! ünïcode we'LL"), (7, "a\x0bb\x0cc\x1cd\x85e")]
    shards = tokens.write_shards(docs(spark, [(*r, 1) for r in rows], "doc_id long, text string, start int"), f"file://{tmp_path}/t", path, shard_tokens=50)
    got = sorted(tokens.read_shards(shards).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert shards.count() > 1 and tokens.token_output(docs(spark, []), path).count() == 0


def test_other_tokenizers(spark, tmp_path):
    """A file of other rules, and an end id beyond 16 bits, give the library's own ids."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = [(1, "Hello  World, it's 42\n<|endoftext|> ok"), (2, "naïve ÜBER"), (3, None)]
    for name, end in (("byte_bpe_50k.json", 5), ("word_bpe_49k.json", 70_000)):
        plain = Tokenizer.from_file(P.path(name))
        got = tokens.token_output(docs(spark, rows), P.path(name), f"file://{tmp_path}/{name}", end).orderBy("start").collect()
        at = 0
        for r, (d, t) in zip(got, rows, strict=True):
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, end]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, most in ((0, 2), (1, 1), (700, 5), (5000, 49408), (3000, 70000)):
        ids = rng.integers(0, most, n)
        shard = tokens.Shard(tokens.pack_shard(ids, [1], np.array([n])))
        assert (shard.tokens() == ids).all()
        for i in rng.integers(0, n, min(n, 40)).tolist():
            t, places = int(ids[i]), np.flatnonzero(ids == ids[i])
            assert shard.access(i) == t and shard.count(t) == len(places) and shard.count(t, 0, i) == (places < i).sum()
            assert shard.find(t, len(places) - 1) == places[-1] and shard.find(t, len(places)) == -1
        assert shard.count(1 << 20) == 0
    with pytest.raises(ValueError):
        tokens.Shard(b"something else")


# --- 10 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(10)
    parts = {"aa": ["the", "ing", "tion", "wh"], "bb": ["que", "eau", "oux", "lle"], "cc": ["при", "вет", "мир"]}
    return lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark, speech):
    rows = [(i, speech(l, 40), l, "s", 0) for i, l in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa", "s", 0), (501, "", None, "s", 0), (502, "12 34 !!", "bb", "s", 0), (503, LONG, None, None, None), (None, speech("bb", 9), None, "s", 0), (504, speech("aa", 30) + ". " + speech("bb", 60), None, "s", 0)]
    rows += [(505, "\u0301 12 \u0301\u0302 3", None, "s", 0), (506, "1\u0301", "aa", "s", 0), (507, rows[0][1], None, None, 0), (507, rows[0][1], None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in langid.language_id(df).collect()}
    assert all(out[r[0]].lang_pred == r[2] for r in rows[:120])
    assert [out[i].lang_pred for i in (500, 501, 502, None, 504, 505, 506, 507)] == ["und", "und", "und", "bb", "bb", "und", "und", "aa"] and out[500].score == 0 and 0.5 < out[504].score < 0.8
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in out if d is not None)
    model = langid.fit(df.where("lang is not null"))
    spans = langid.identify(df.where("doc_id = 504"), model, spans=True).first().spans
    assert [s.lang for s in spans] == ["aa", "bb"] and abs(spans[0].past - 30) <= 1
    assert langid.in_a_language(df, model).where("doc_id in (500, 501, 502)").count() == 0 and langid.in_a_language(df, model).columns == df.columns
    assert langid.language_id(df.limit(0)).count() == 0


def test_many_and_rare_languages(spark):
    rng = random.Random(11)
    tongues = [[chr(0x4E00 + 40 * i + j) for j in range(30)] for i in range(300)]
    say = lambda i: " ".join("".join(rng.choice(tongues[i]) for _ in range(3)) for _ in range(20))
    rows = [(i, say(i % 300), f"l{i % 300}") for i in range(1200)] + [(2000 + i, say(0), "l0") for i in range(600)]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    model = langid.fit(df, 20)
    assert len(model.languages) == 300
    got = langid.identify(df, model).collect()
    want = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.98 * len(rows)


def test_marks_belong_to_letters():
    grams = langid.Grams(["e\u0301a 1\u0301b", "\u0301", "a\u0301\u0302"])
    assert grams.letters.tolist() == [3, 1, 3] and grams.row.tolist() == [0, 0, 2]


def test_path_is_the_best_one():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((1, 3), bool))
    lengths = [0, 5, 1, 7, 0, 3]
    word = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 8
    first = np.concatenate([[0], np.cumsum(lengths)])
    path = model._path(word.copy(), first)
    import itertools

    for a, b in zip(first, first[1:], strict=False):
        cost = lambda p: sum(word[a + i, l] for i, l in enumerate(p)) - langid.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if b > a:
            assert cost(path[a:b].tolist()) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_entry_survives_without_this_subpackage(tmp_path):
    """What the driver does: both folders and the pipeline deleted."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/inkplan", tmp_path / "inkplan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names = json.loads(said.stdout)
    assert "encode_lossless" in names and not any(n.startswith("op") or n == "pipeline" for n in names) and F is not None


def test_grams_take_little_memory():
    import tracemalloc

    texts = ["Das ist ein Satz, und noch einer. " * 2000] * 8
    langid.Grams(texts)
    tracemalloc.start()
    langid.Grams(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, texts))


def test_language_pieces_take_little_memory():
    """All that is made for a piece of texts, words and scores included, with four languages."""
    import tracemalloc

    import pyarrow as pa

    from inkplan.llm import langid
    from inkplan.llm.common import pieces

    model = langid.Model(list("abcd"), np.zeros((langid.SLOTS, 4), np.float32), np.ones((len(langid._NAMES), 4), bool))
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text " * 100] * 4000)], ["text"])
    model.predict(["a"])
    piece = next(pieces(batch, "text", model.bytes_at_once()))
    tracemalloc.start()
    model.predict(piece.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_tokens_remember_frequent_words(monkeypatch):
    """When the memory of words is full, those that come again stay known; ids are the library's either way."""
    import public_tokenizers

    from inkplan.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 80)
    words = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"), 1)
    asked = []

    class Model:
        tokenize = staticmethod(lambda piece, model=words.model: asked.append(piece) or model.tokenize(piece))

    words.model = Model
    text = " ".join(f"Zürich {a}{b}, the (zürich) it's 'so''{a}" for a in "abcdef" for b in "ghijkl")
    assert np.frombuffer(words.encode(text), words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count("the") == 1 and len(words) + len(words.older) <= 80


def test_workers_give_memory_back(spark, tmp_path):
    """Workers outlive their tasks: what a task has freed may not stay with them, in each stage of the pipeline that cuts texts up."""
    import public_tokenizers
    import pyarrow as pa

    def kept():
        def look(batches):
            import ctypes

            rest = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon"))  # noqa: E731, SIM115
            for batch in batches:
                held = rest()
                pa.default_memory_pool().release_unused()
                ctypes.CDLL(None).malloc_trim(0)
                yield pa.RecordBatch.from_arrays([pa.array([(held - rest()) >> 10] * len(batch), pa.int64())], ["mb"])

        return max(r.mb for r in spark.range(0, 32, 1, 32).mapInArrow(look, "mb long").collect())

    words = "transform(sequence(1, 400), i -> translate(hex(xxhash64(id, i)), '0123456789', 'ghijklmnop'))"
    docs = spark.range(0, 1000, 1, 4).selectExpr("id as doc_id", f"lower(concat_ws(' ', {words})) as text", "if(id % 2 = 0, 'a', 'b') as lang")
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/documents")
    model = langid.fit(docs)
    left = {}
    for name, run in (("language", lambda: langid.in_a_language(docs, model)), ("near", lambda: jaccard.one_of_each(docs)), ("tokens", lambda: tokens.token_output(docs, public_tokenizers.path("word_bpe_49k.json")))):
        kept()
        assert run().count() == 1000
        left[name] = kept()
    assert max(left.values()) <= 12, left
