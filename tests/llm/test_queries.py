"""The registered queries on the smallest tables, and the pipeline, against brute force."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkplan.llm.queries import oracle_sql, queries
from tests.llm.test_operators import brute_embeddings, brute_targets, classes, shingle_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def run(spark):
    done = {}
    return lambda name: done[name] if name in done else done.setdefault(name, queries()[name](spark, SF).collect())


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def encoder():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]


def token_rows(rows, encode):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = encode(t)
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def near_classes(rows, k, num, den):
    sets = {d: shingle_set(t, k) for d, t in rows}
    places = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            places[x].append(d)
    both = Counter((a, b) for ds in places.values() for a in ds for b in ds if a < b)
    return sets, classes(sorted(sets), [p for p, n in both.items() if den * n >= num * (len(sets[p[0]]) + len(sets[p[1]]) - n)])


def test_op1(run, table):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in table("embeddings")]
    got = sorted((True, r.vec_id, r.n_links, r.component_id) for r in run("op1_embedding_near_dedup"))
    assert got == brute_embeddings(rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(run, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = run(name)
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got[0].asDict())
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want.fetchall(), key=str)


def test_op3(run, table):
    turns = defaultdict(list)
    for r in table("conversations"):
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        want.add((c, len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss)))
    assert {tuple(r)[:5] for r in run("op3_chat_format")} == want


def test_op4(run, table):
    rows, sizes = table("documents"), Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    want, taken = brute_targets(sizes), Counter()
    got = run("op4_mix_sources")
    assert {(r.doc_id, r.size) for r in got} == {(r.doc_id, size(r.text)) for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 2 for s in sizes)


def test_op5(run, table):
    rows = [(r.doc_id, r.text) for r in table("documents")]
    sets, low = near_classes(rows, 3, 9, 10)
    assert {tuple(r) for r in run("op5_jaccard_join")} == {(d, len(sets[d]), low[d]) for d, _ in rows}


def test_op6(run, table):
    known = re.compile(r'AKIA[A-Z0-9]{16}|(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}')
    assert {(r.doc_id, r.value) for r in run("op6_secret_scan")} >= {(r.doc_id, v) for r in table("documents") for v in known.findall(r.text or "")}


def test_op7(run, table):
    rows, first = table("pages"), {}
    for r in sorted(rows):
        first.setdefault(r.html or "", r.page_id)
    want = set()
    for r in rows:
        data, f = (r.html or "").encode(), first[r.html or ""]
        want.add((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == r.page_id else "revisit", None if f == r.page_id else f))
    assert {tuple(r) for r in run("op7_warc")} == want


def test_op8(run, table):
    found = {(r.doc_id, r.item_id) for r in run("op8_decontaminate")}
    assert found >= {(d.doc_id, b.item_id) for d in table("documents") for b in table("benchmark") if b.text.lower() in (d.text or "").lower()}


def test_op9(run, table):
    assert sorted(map(tuple, run("op9_token_output"))) == token_rows([(r.doc_id, r.text) for r in table("documents")], encoder())


def test_op10(run, table):
    lang = {r.doc_id: r.lang for r in table("documents")}
    got = run("op10_language_id")
    assert {r.doc_id: r.held_out for r in got} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in lang}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_pipeline(spark, table):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], SF).collect(), docs.schema))
        assert kept[-1].columns == docs.columns, name
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]
    letters = [(d, t) for d, t in rows[0] if any(c.isalpha() for c in t or "")]
    assert set(rows[1]) <= set(letters) and len(rows[1]) >= 0.98 * len(letters)
    _, low = near_classes(rows[1], 5, 8, 10)
    assert sorted(rows[2]) == sorted((d, t) for d, t in rows[1] if low[d] == d)
    bench = [b.text.lower() for b in table("benchmark")]
    leaked = {d for d, t in rows[2] if any(b in t.lower() for b in bench)}
    assert not leaked & {d for d, _ in rows[3]} and len(rows[3]) >= len(rows[2]) - len(leaked) - 2
    sources, sizes, taken = {r.doc_id: r.source for r in kept[3].collect()}, Counter(), Counter()
    for d, t in rows[3]:
        sizes[sources[d]] += size(t)
    for d, t in rows[4]:
        taken[sources[d]] += size(t)
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 3 for s in sizes) and max(Counter(rows[4]).values()) <= 3
    final = token_rows(rows[4], encoder())
    assert sorted(map(tuple, stages["token ids"](spark, kept[4], SF).collect())) == sorted(final)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(final)
