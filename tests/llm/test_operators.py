"""Operators against brute force on small fixtures: nulls, empty texts, repeated rows, ties,
empty tables, extra columns with clashing names."""
import base64
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fansignal.llm import op2_packing, op3_token_counts, op6_passages, op8_quality

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def edited(t, at):
    w = t.split()
    w[at] = "changed"
    return " ".join(w)


BASE = text(1, 120)
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, edited(BASE, 60), "en", "b", 1),
    (4, text(2, 90), "en", None, 1), (5, "", "en", "b", 1), (6, None, None, None, None), (7, "two words", "en", "b", 1),
    (8, "TWO Words", "en", "c", 1), (9, text(3, 40) + " " + " ".join(BASE.split()[20:85]), "en", "c", 1),
    (None, text(4, 30), "en", "c", 1), (11, text(5, 5000), "en", "a", 1), (11, text(5, 5000), "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for extra in ("version", "mix_size", "label", "key", "chunk", "quality_score"):
        d = d.withColumn(extra, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_near_duplicates(docs, none):
    from fansignal.llm.op1_minhash import near_duplicates
    got = {(r.doc_id, r.n_shingles): r for r in near_duplicates(docs, k=3, percent=85).collect()}
    n = {r[0]: len({tuple(words(r[1])[i:i + 3]) for i in range(max(1, len(words(r[1])) - 2))}) if words(r[1]) else 0 for r in ROWS}
    comp = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 11: 11, 4: 4, 5: 5, 6: 6, 9: 9}
    for (i, size), r in got.items():
        assert size == n[i]
        if i is not None:
            assert (r.component_id, r.kept) == (comp[i], comp[i] == i)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_across_components(spark):
    """Families of edits that share buckets without being linked: components equal brute force."""
    base, r, texts = [f"v{i}" for i in range(120)], np.random.default_rng(11), []
    for _ in range(6):
        family = list(base)
        for at in r.integers(0, 120, 4):
            family[at] = f"f{r.integers(0, 10**6)}"
        for _ in range(10):
            member = list(family)
            for at in r.integers(0, 120, 2):
                member[at] = f"m{r.integers(0, 10**6)}"
            texts.append(" ".join(member))
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    comp = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    from fansignal.llm.op1_minhash import near_duplicates
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=85)
    assert {x.doc_id: x.component_id for x in got.collect()} == dict(enumerate(comp))
    assert 1 < len(set(comp)) < len(comp)


def test_near_duplicates_of_repeated_ids(spark):
    """An id with several texts is one node; a null id has no component."""
    a, b, c = text(50, 40), text(51, 40), text(52, 40)
    rows = [(3, a), (5, a), (5, b), (9, b), (10, c), (None, a), (None, c), (12, ""), (12, c), (2, None)]
    from fansignal.llm.op1_minhash import near_duplicates
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in near_duplicates(df, k=3, percent=85).collect()}
    assert got == {(3, True): (3, True), (5, True): (3, False), (9, True): (3, False), (10, True): (10, True), (12, True): (10, False),
                   (12, False): (12, True), (2, False): (2, True), (None, True): (None, True)}


def test_operators_run_on_workers_without_the_package(spark):
    """What op4 sends to its tasks can be loaded where the package cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from fansignal.llm import op1_minhash, op4_embeddings, op12_warc, op13_conversations
    parts = [op4_embeddings._deal(0.9), op4_embeddings._links(0.9), op1_minhash._sets(3), op12_warc._writer("/x", "d"), op12_warc._reader(False, []),
             op13_conversations._stream("/x", 5, False, []), op2_packing._chunks("f", "p", 8)]
    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert not any(m.startswith('fansignal') for m in sys.modules)"
    for p in parts:
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(p), cwd="/", capture_output=True,
                              env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
        assert done.returncode == 0, done.stderr.decode()[-500:]


def test_packing_is_lossless(docs, none):
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = op2_packing.packed_sequences(docs, rank_file, public_tokenizers.PATTERN, 256).collect()
    enc = op2_packing.Encoder(rank_file, public_tokenizers.PATTERN)
    parts = defaultdict(list)
    for r in rows:
        assert len(r.ids) == len(r.position_ids) == 256 and r.cu_seqlens[-1] == r.n_tokens
        for k, (d, no) in enumerate(zip(r.doc_ids, r.chunk_nos, strict=True)):
            a, b = r.cu_seqlens[k:k + 2]
            assert r.position_ids[a:b] == list(range(b - a))
            parts[d].append((no, r.ids[a:b]))
    for d in {r[0] for r in ROWS}:
        texts = [r[1] for r in ROWS if r[0] == d and r[1]]
        got = sorted(parts[d], key=lambda x: x[0])
        assert sum(len(x) for _, x in got) == sum(len(enc.enc.encode_ordinary(t)) + 1 for t in texts)
        if len(texts) == 1:
            ids = [i for _, x in got for i in x]
            assert enc.enc.decode(ids[:-1]) == texts[0] and ids[-1] == enc.end
    assert op2_packing.packed_sequences(none, rank_file, public_tokenizers.PATTERN).count() == 0


def test_binary_output_equals_the_rows(spark, docs):
    import uuid

    from fansignal.session import shared_dir
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    packed = op2_packing.packed_sequences(docs, rank_file, public_tokenizers.PATTERN, 256).repartition(3).persist()
    folder = f"{shared_dir(spark)}/packed/{uuid.uuid4().hex}"
    for dtype, at in (("<i4", folder), ("<u2", folder + "-2")):
        got = []
        for f in op2_packing.write_packed(packed, at, dtype).collect():
            ids, pos, cu = op2_packing.read_packed(at, f.part, f.rows, f.row_len, f.id_bytes)
            assert f.segments == sum(len(c) - 1 for c in cu) and f.id_bytes == int(dtype[-1])
            got += [(i.tolist(), p.tolist(), c) for i, p, c in zip(ids, pos, cu, strict=True)]
        assert sorted(got) == sorted((list(r.ids), list(r.position_ids), list(r.cu_seqlens)) for r in packed.collect())
    assert op2_packing.write_packed(packed.filter("false"), folder + "-3").count() == 0


def test_best_fit_against_linear_search():
    lengths = [int(x) for x in np.random.default_rng(0).integers(1, 65, 500)]
    rows = op2_packing.best_fit_decreasing(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sum(lengths[i] for i in r) <= 64 for r in rows)
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(64 - n)
    assert len(rows) == len(left)


def test_encoder_units_equal_whole_text():
    enc = op2_packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for t in ["a b", " a", "a ", "a  b", "x\n y", "x \ny", "don't stop 12 ab12 é ü", "a  b", "\t"]:
        assert enc.encode(t).tolist() == enc.enc.encode_ordinary(t)


def test_token_counts(docs, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    counter = op3_token_counts.PieceCounter(model)
    assert counter.splits and len(counter.whole) > 30000
    odd = ["", None, " ", "\n", "a\nb", "▁", "a▁ b", "<s> </s><unk>", "x\x00y", "ﬁ ½ é 字", "  two  spaces ", BASE]
    assert counter.counts(odd) == [len(counter.sp.encode(t)) if t else 0 for t in odd]
    got = op3_token_counts.token_counts(docs, model).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(
        (i, len((t or "").encode()), len(counter.sp.encode(t or ""))) for i, t, *_ in ROWS)
    assert op3_token_counts.token_counts(none, model).count() == 0


def test_embedding_links(spark):
    from fansignal.llm.op4_embeddings import embedding_links
    r = np.random.default_rng(2)
    base = r.standard_normal((6, 16))
    vecs = [(i, (base[i % 6] + 0.05 * r.standard_normal(16)).tolist(), i % 6 % 2) for i in range(60)]
    odd = [(100, None, 0), (101, [], 0), (102, [0.0] * 16, 0), (103, [float("nan")] * 16, 0), (104, [None] * 16, 0),
           (105, vecs[0][1], None), (None, vecs[0][1], 0), (106, [1.0, 2.0], 0), (0, vecs[0][1], 0)]
    d = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<double>, label int").withColumn("dim", F.lit("x"))
    got = {x.vec_id: x for x in embedding_links(d).collect()}
    assert len(got) == 60 + 8
    v = np.array([x[1] for x in vecs])
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = (v @ v.T >= 0.93) & (np.array([x[2] for x in vecs])[:, None] == np.array([x[2] for x in vecs])[None])
    np.fill_diagonal(link, False)
    for i in range(60):
        assert got[i].n_links == link[i].sum()
        assert got[i].component_id == min([i, *np.flatnonzero(link[i])]) or link[i].sum() == 0 or got[i].component_id < i
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103, 104, 105, 106, None))
    assert embedding_links(d.limit(0)).count() == 0


def test_embedding_links_of_split_labels(spark, monkeypatch):
    """Labels dealt to many sub-cells: every pair counts once, however many groups hold it."""
    from fansignal.llm import op4_embeddings
    r = np.random.default_rng(6)
    base = r.standard_normal((5, 16))
    v = base[np.arange(120) % 5] + 0.12 * r.standard_normal((120, 16))
    label = np.where(np.arange(120) < 90, 0, 1)
    link = ((v / np.linalg.norm(v, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T >= 0.93)
    link &= (label[:, None] == label[None]) & ~np.eye(120, dtype=bool)
    low = np.arange(120)
    for _ in range(120):
        low = np.array([min([low[i], *low[link[i]]]) for i in range(120)])
    d = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(120)], "vec_id long, embedding array<double>, label int")
    for rows in (8, 8192):
        monkeypatch.setattr(op4_embeddings, "CELL_ROWS", rows)
        got = {x.vec_id: (x.n_links, x.component_id) for x in op4_embeddings.embedding_links(d).collect()}
        assert got == {i: (link[i].sum(), low[i]) for i in range(120)}


def test_decontamination(spark, docs, none):
    from fansignal.llm.op5_decontamination import contaminated_words, without_contaminated
    items = spark.createDataFrame([(10, " ".join(BASE.split()[30:50])), (11, "two WORDS"), (12, None), (13, "!!"),
                                   (None, "two words"), (11, "two words")], "item_id long, text string")
    got = {r.doc_id: r for r in contaminated_words(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].item_ids) == (20, 1, ["10"])
    assert (got[7].n_hit, got[7].item_ids, got[8].n_hit) == (2, ["11"], 2)
    assert got[6].n_words == 0 and not got[5].contaminated and got[9].contaminated and not got[4].contaminated
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 6, 11, 11]
    assert contaminated_words(none, items).count() == 0
    assert not any(r.contaminated for r in contaminated_words(docs, items.limit(0)).collect())


def test_passages(docs, none):
    got = {(r.doc_id, r.other_id): r for r in op6_passages.repeated_passages(docs).collect()}
    assert set(got) == {(2, 1), (3, 1), (9, 1)}
    assert (got[9, 1].start, got[9, 1].end, got[9, 1].other_start, got[9, 1].other_end) == (40, 105, 20, 85)
    assert got[3, 1].matched == 119 and got[2, 1].identity == 1.0
    assert op6_passages.repeated_passages(none).count() == 0


def test_passages_whose_parts_came_first(spark):
    """Every seed of the passage is first seen in documents that lack the whole of it."""
    w = text(41, 50).split()
    parts = [" ".join([text(50 + at, 20), *w[at:at + 24], text(80 + at, 20)]) for at in range(0, 27, 2)]
    rows = [*enumerate(parts), (100, f"{text(42, 30)} {' '.join(w)} {text(43, 20)}"), (101, f"{' '.join(w)} {text(44, 40)}")]
    got = op6_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc_id, x.other_id, x.start, x.end, x.other_start) for x in got] == [(101, 100, 0, 50, 30)]


def test_fuzzy_passages(spark):
    """50-word passages with every 12th or 7th word changed, in texts that share nothing else."""
    rows, r = [], np.random.default_rng(31)
    fresh = iter(f"u{i}" for i in range(10**6))
    for k in range(40):
        step = (12, 7)[k % 2]
        base = [next(fresh) for _ in range(50)]
        near = list(base)
        for at in range(int(r.integers(2, step - 2)), 49, step):
            near[at] = next(fresh)
        for doc, words_of in ((k, base), (100 + k, near)):
            rows.append((doc, " ".join([*(next(fresh) for _ in range(30)), *words_of, *(next(fresh) for _ in range(30))])))
    got = op6_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=40).collect()
    assert {(x.doc_id, x.other_id) for x in got} >= {(100 + k, k) for k in range(0, 40, 2)}
    assert len({(x.doc_id, x.other_id) for x in got} & {(100 + k, k) for k in range(40)}) >= 38


def aligned(texts):
    """Rows of _align for the second and later texts, each with the first."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(2, len(texts) + 1)], pa.int64()),
                                        pa.array([1] * len(texts), pa.int64()), pa.array(texts)], ["doc_id", "other_id", "text"])
    return [r for b in op6_passages._align(50, 0.8)([batch]) for r in b.to_pylist()]


def test_passages_of_shortest_fragments():
    """Every (K + 1)-th word changed: only fragments of exactly K words, which form one chain."""
    base = text(21, 90)
    w = base.split()
    for at in range(op6_passages.K, 90, op6_passages.K + 1):
        w[at] = f"new{at}"
    rows = aligned([base, text(22, 30) + " " + " ".join(w)])
    assert len(rows) == 1 and rows[0]["start"] == 30 and rows[0]["end"] >= 115


def test_passages_with_repeated_words():
    """A stray copy of a part does not take the whole passage's matches; every copy is told."""
    base = text(23, 60)
    part = " ".join(base.split()[:20])
    rows = aligned([f"{text(24, 30)} {base}", f"{part} {text(25, 40)} {base}", f"{base} {text(26, 40)} {base}",
                    " ".join(["same"] * 3000)])
    assert [(r["doc_id"], r["start"], r["end"], r["other_start"], r["other_end"]) for r in sorted(
        rows, key=lambda r: (r["doc_id"], r["start"]))] == [(2, 60, 120, 30, 90), (3, 0, 60, 30, 90), (3, 100, 160, 30, 90)]
    junk = " ".join(["same"] * 3000)
    assert [(r["start"], r["end"]) for r in aligned([f"{junk} {base}", f"{base} {junk}"])] in ([(60, 3060), (0, 60)], [(0, 60), (60, 3060)])


def test_runs_of_frequent_words_against_brute_force():
    """Every maximal run of equal k-mers, however frequent they are; alone fragments are told as long as words are new."""
    from fansignal.llm.words import shingle_hashes
    r, k, seen = np.random.default_rng(5), op6_passages.K, set()
    for n, m, kinds in ((200, 150, 1), (300, 200, 2), (250, 250, 3), (80, 300, 40), (6, 400, 1), (400, 300, 12)):
        line = r.integers(0, kinds, 12)
        a, b = (shingle_hashes(np.where(r.random(size) < 0.05, r.integers(0, kinds + 1, size), np.resize(line, size)).astype(np.uint64), k)
                for size in (n, m))
        equal = a[:, None] == b[None, :]
        want = []
        for x, y in zip(*np.nonzero(equal), strict=True):
            if x and y and equal[x - 1, y - 1]:
                continue
            run = 0
            while x + run < len(a) and y + run < len(b) and equal[x + run, y + run]:
                run += 1
            want.append((x, y, run + k - 1))
        found, frequent = op6_passages.fragments(a, op6_passages.Places(b))
        seen.add(frequent)
        assert sorted(zip(*found.tolist(), strict=True)) == sorted(want)
    assert seen == {True, False}


def test_passages_of_frequent_words():
    """All words of a long repetition are told, in few rows, and a repetition inside one text as well."""
    hub, doc = f"{text(91, 60)} {'so ' * 120}{text(92, 60)}", f"{text(93, 30)} {'so ' * 1000}{text(94, 30)}"
    rows = aligned([hub, doc])
    assert set().union(*(range(r["start"], r["end"]) for r in rows)) >= set(range(30, 1030)) and len(rows) < 15
    assert all(r["identity"] == 1.0 for r in rows if 30 <= r["start"] and r["end"] <= 1030)
    import pyarrow as pa
    own = f"{'so ' * 400}{text(95, 80)}"
    batch = pa.RecordBatch.from_arrays([pa.array([None, 1], pa.int64()), pa.array([1, 1], pa.int64()), pa.array([own, own])],
                                       ["doc_id", "other_id", "text"])
    told = [x for b in op6_passages._align(50, 0.8)([batch]) for x in b.to_pylist()]
    assert set().union(*(range(x["start"], x["end"]) for x in told)) >= set(range(50, 400))
    assert all(x["start"] - x["other_start"] >= 50 for x in told)


def test_exact_passages_against_brute_force(spark):
    """Every document with 50 words of an earlier one, or twice 50 of its own far apart, is told; others are not."""
    r = np.random.default_rng(77)
    fresh = iter(f"w{i}" for i in range(10**6))
    shared = [[next(fresh) for _ in range(int(n))] for n in r.integers(30, 120, 12)]
    rows = []
    for doc in range(60):
        w = []
        for _ in range(3):
            part = shared[int(r.integers(12))]
            lo = int(r.integers(0, 20))
            w += [next(fresh) for _ in range(25)] + part[lo:]
        rows.append((doc, " ".join(w)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, " ".join(next(fresh) for _ in range(90)))]
    first, want = {}, set()
    for doc, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            x = tuple(w[i:i + 50])
            if x in first and (first[x][0] != doc or i - first[x][1] >= 50):
                want.add(doc)
            first.setdefault(x, (doc, i))
    got = op6_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got if x.identity == 1.0 and x.matched >= 50} >= want
    texts = {doc: t.split() for doc, t in rows}
    for x in got:
        assert x.end - x.start >= 50 or x.other_end - x.other_start >= 50
        assert x.other_id < x.doc_id or (x.other_id == x.doc_id and x.other_start < x.start)
        if x.identity == 1.0:
            assert texts[x.doc_id][x.start:x.end] == texts[x.other_id][x.other_start:x.other_end]
    assert {x.other_id for x in got if x.doc_id in (70, 71)} == {3} and not any(x.doc_id == 72 for x in got)


def test_passages_of_a_document_with_many_partners(spark, monkeypatch):
    """A first document whose partners are dealt to several groups."""
    base = text(61, 70)
    rows = [(k, f"{text(100 + k, 30)} {base} {text(200 + k, 20)}") for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(op6_passages.repeated_passages(d).collect())
    monkeypatch.setattr(op6_passages, "PARTNERS", 3)
    assert sorted(op6_passages.repeated_passages(d).collect()) == whole
    assert {(x.doc_id, x.other_id) for x in whole} == {(k, 0) for k in range(1, 12)}


def test_first_holders_over_partitions():
    """Seeds that go on over batches and partitions get the first holder of all."""
    import pyarrow as pa
    rows = sorted([(s, d, p) for s, n in ((1, 1), (2, 40), (3, 2), (4, 1), (5, 3), (6, 1)) for d in range(n) for p in range(1 + (d == 0) * (s == 6))])
    least, count = {}, Counter(s for s, _, _ in rows)
    for s, d, p in rows:
        least.setdefault(s, (d, p))
    want = sorted((d, p, *least[s]) for s, d, p in rows if count[s] > 1)
    r = np.random.default_rng(3)
    for _ in range(50):
        cuts = sorted(r.integers(0, len(rows) + 1, 4).tolist())
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:min(k + 3, hi)], strict=True), (
                pa.int64(), pa.int64(), pa.int32()), strict=True)], ["seed", "doc_id", "pos"]) for k in range(lo, hi, 3)]
            out += list(op6_passages._first_holders(batches))
        edges = {e for b in out for e in b.column(4).to_pylist() if e is not None}
        assert len(edges) <= 2 * 5
        firsts = {e: least[e] for e in edges if count[e] > 1}
        assert sorted(tuple(x.values()) for b in op6_passages._settled(firsts)(out) for x in b.to_pylist()) == want


def test_mixing(docs, none):
    from fansignal.llm.op7_mixing import emitted, mix
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.mix_copies <= 2 for r in rows)
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(words(r[1]))
    target = {r.source: r.mix_target for r in rows}
    assert math.isclose(sum(target.values()), min(1.5, 2) * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    again = emitted(mix(docs), docs.columns)
    assert again.columns == docs.columns and again.count() == sum(r.mix_copies for r in rows)
    assert mix(none).count() == 0


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(5)
    counts = Counter()
    for _ in range(20000):
        bad = r.random() < 0.2
        v = [int(r.choice(3, p=[0.1, 0.4, 0.5] if bad else [0.1, 0.8998, 0.0002])) for _ in op8_quality.LABELLERS]
        counts[sum(x * 3 ** k for k, x in enumerate(reversed(v)))] += 1
    _, prior, table = op8_quality.label_model(dict(counts))
    assert abs(prior - 0.8) < 0.03 and np.abs(table[0, :, op8_quality.BAD] - 0.5).max() < 0.05


def test_quality_on_labelled_documents(spark, docs, none, sf_dir):
    got = op8_quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("quality", "quality_kept").collect()
    good = [r.quality_kept for r in got if r.quality == 1]
    junk = [r.quality_kept for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.05 * len(junk)
    out = op8_quality.quality(docs)
    assert out.count() == len(ROWS) and not any(r.quality_kept for r in out.collect() if not r.text)
    assert op8_quality.quality(none).count() == 0


def test_toxic_documents_are_not_kept(spark, sf_dir):
    from fansignal.llm.queries import op8_quality as query
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = query(spark, sf_dir).join(labels, "doc_id").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    hit = [r for r in rows if r.toxic and op8_quality.toxic(r.text.encode())]
    assert len(hit) >= 0.4 * sum(r.toxic for r in rows) and not any(r.kept for r in hit)
    clean = [r for r in rows if not r.toxic]
    assert not any(op8_quality.toxic(r.text.encode()) for r in clean)
    good = [r.kept for r in clean if r.quality]
    assert sum(good) >= 0.98 * len(good)
    assert op8_quality.toxic(b"You IDIOT, what a loser!") and not op8_quality.toxic(b"word " * 300 + b"trash")


def test_lm_scores(docs, none):
    from fansignal.llm.op9_lm_scoring import ORDER, lm_scores
    rows = lm_scores(docs).collect()
    assert len(rows) == len(ROWS) and lm_scores(none).count() == 0
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in ROWS}
    count, trie = Counter(), [defaultdict(Counter) for _ in range(ORDER + 1)]

    def body(t):
        return b"\n" * ORDER + b" ".join(words(t)) + b"\n"
    for i, t, *_ in ROWS:
        if not held[i]:
            count.update([*words(t), b"\n"])
            b = body(t)
            for p in range(ORDER, len(b)):
                for o in range(ORDER + 1):
                    trie[o][b[p - o:p]][b[p]] += 1
    total, kinds = sum(count.values()), len(count)

    def log10(b, p):
        out, gone = 0.0, set()
        for o in range(ORDER, -1, -1):
            left = {s: n for s, n in trie[o].get(b[p - o:p], {}).items() if s not in gone}
            if left:
                both = sum(left.values()) + len(left)
                if b[p] in left:
                    return out + math.log10(left[b[p]] / both)
                out += math.log10(len(left) / both)
                gone |= set(left)
        return out - math.log10(252 - len(gone))
    want = Counter()
    for i, t, *_ in ROWS:
        b, w = body(t), [*words(t), b"\n"]
        want[(i, held[i], len(w), sum(count[x] > 0 for x in w), total,
              round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 4),
              round(sum(log10(b, p) for p in range(ORDER, len(b))), 4))] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4),
                            round(r.score, 4)) for r in rows)


def test_licences(spark, docs, none):
    from fansignal.llm.licence_texts import KNOWN
    from fansignal.llm.op10_licences import known_licences, licence_scan
    mit = dict(reversed([k for k in KNOWN if k[1].startswith("Permission is hereby")]))["MIT"]
    texts = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (2, "prose\nreleased under the MIT Licence!\nmore"),
             (3, None), (4, ""), (2, "prose\nreleased under the MIT Licence!\nmore"), (None, "All rights reserved.")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("licence", F.lit(2))
    rows = licence_scan(d, known_licences(spark)).collect()
    assert Counter((r.doc_id, r.licence, tuple(r.notices), r.n_notice_lines) for r in rows) == Counter(
        [(1, "MIT", (), 0), (2, None, ("MIT",), 1), (2, None, ("MIT",), 1), (3, None, (), 0), (4, None, (), 0),
         (None, None, ("Proprietary",), 1)])
    assert licence_scan(none, known_licences(spark)).count() == 0
    assert licence_scan(docs, known_licences(spark).limit(0)).count() == len(ROWS)


def test_components(spark):
    from fansignal.llm.graph import connected_components
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 60), (70, 60), (80, 80), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50}


def test_pipeline(spark, docs, sf_dir):
    import corpus_pipeline as p
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES[:-1]:
        d = stage(spark, d, sf_dir)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in d.collect()} <= {1, 4, 7, 8, 9, 11, None}
    assert p.run(spark, sf_dir).count() > 0
