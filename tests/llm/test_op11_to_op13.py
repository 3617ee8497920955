"""op11 to op13 against brute force on small fixtures: nulls, empty and long texts, repeated
rows, ties, hot groups, empty tables, extra columns with clashing names."""
import base64
import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fansignal.llm import op11_manifest, op12_warc, op13_conversations
from fansignal.session import shared_dir

CLASH = ("n", "pos", "g", "h", "leaf", "path", "run", "same", "url_", "place", "seen", "kind", "back", "fault", "absent_", "version")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# ---- op11 -----------------------------------------------------------------------------

def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels_of(nodes, fanout=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def proof_of(levels, i, fanout=16):
    out = []
    for nodes in levels[:-1]:
        s = i // fanout * fanout
        out.append(("".join(nodes[s:i]), "".join(nodes[i + 1:s + fanout])))
        i //= fanout
    return out


def merkle(rows):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda r: H("".join("-" if r[k] is None else f"{len(str(r[k]).encode())}:{r[k]}" for k in fields))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = levels_of([x[2] for x in groups[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, h, r) in enumerate(groups[s]):
            steps, x = proof_of(trees[s], i) + proof_of(top, at), h
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                x = leaf({**r, "text": re.sub("[A-Z]", lambda m: m.group().lower(), r["text"])})
            for a, b in steps:
                x = H(a + x + b)
            out.append((r["doc_id"], h, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(n, sources):
    return [(i, ["Some Text %d" % i, "", None, "ÀB plain", "long word " * 3000][i % 5], "en" if i % 3 else None, sources[i % len(sources)], i if i % 4 else None)
            for i in range(n)]


@pytest.mark.parametrize("rows", [
    doc_rows(700, ["a", "a", "a", None, "b", "Ö", "a"]),                                    # three levels in one source
    doc_rows(40, [f"s{i}" for i in range(18)]),                                             # more sources than one run
    [(1, "x", None, None, None)], [(1, "X", "en", "only", 1)] * 3,                           # a lone leaf, equal rows only
    [(None, "x", "en", "a", 1), (None, "y", "en", "a", 1), (7, "B", "en", "a", 1), (7, "A", "en", "a", 1), (7, "A", "en", "a", 1)],
    doc_rows(16, ["a"]), doc_rows(17, ["a"]), doc_rows(272, ["a"]),                          # full runs, one more, 17 runs
])
def test_manifest_equals_brute_force(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(5))
    got = op11_manifest.verified_documents(df).collect()
    want = merkle([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_manifest_of_an_empty_table(spark):
    assert op11_manifest.verified_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_levels_and_carried_columns(spark):
    df = spark.createDataFrame(doc_rows(300, ["a", "b"]), DOCS)
    leaves, levels, subroots = op11_manifest.manifest(df, ["doc_id", "text"], "source", "doc_id", fanout=4, carried={"size": F.length("text")})
    assert leaves.columns == ["doc_id", "leaf", "size", "path", "subroot", "root"]
    assert [x.filter("g = '1a'").count() for x in levels] == [150, 38, 10, 3, 1] and subroots.count() == 2
    assert leaves.filter(op11_manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    with pytest.raises(ValueError):
        op11_manifest.manifest(df, ["text"], "source", "doc_id", carried={"pos": F.lit(1)})


# ---- op12 -----------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def page_rows():
    rows = [(i, f"http://e/{i}", f"<html>{'body text ' * (i % 7)}{i % 11}</html>") for i in range(200)]
    rows += [(i, f"http://hot/{i}", "the hot page") for i in range(500, 300, -1)]            # a third of all rows
    rows += [(600, None, None), (601, "", ""), (602, "http://x/\r\nWARC-Type: none", "a\r\n\r\nb"), (None, "http://n", "no id"), (603, "u", "no id"),
             (604, "twice", "same row"), (604, "twice", "same row"), (604, "other", "same row"), (605, "big", "0123456789" * 200_000)]
    return rows


def expected_pages(rows, least=0):
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        first.setdefault(html or "", i)
    seen, out = set(), []
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        body = (html or "").encode()
        again = len(body) >= least and (html or "") in seen
        seen.add(html or "")
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 50])
def test_warc_round_trip(spark, least, monkeypatch):
    rows = page_rows()
    df = with_clashes(spark.createDataFrame(rows, PAGES).repartition(6))
    folder = f"{shared_dir(spark)}/warc/test-{least}-{hashlib.md5(str(id(df)).encode()).hexdigest()}"
    got = op12_warc.archived_pages(df, folder, min_bytes=least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_pages(rows, least)
    payloads = op12_warc.read_archives(spark, folder, payloads=True).filter("record_type = 'response'").collect()
    want = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): (h or "").encode() for _, _, h in rows}
    assert {r.payload_digest: bytes(r.payload) for r in payloads} == want


def test_warc_of_an_empty_table(spark):
    got = op12_warc.archived_pages(spark.createDataFrame([], PAGES), f"{shared_dir(spark)}/warc/test-empty")
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def records(n):
    return [op12_warc.page_record(str(i), f"http://e/{i}", f"<p>common page text, number {i}, {'words ' * (i % 40)}</p>".encode(), "A" * 32, "2024-01-01T00:00:00Z", None)
            for i in range(n)]


def test_archive_has_its_dictionary_in_a_skippable_frame(tmp_path):
    import zstandard
    some = records(3000)
    places = op12_warc.write_archive(str(tmp_path), "a.warc.zst", some, "2024-01-01T00:00:00Z")
    raw = (tmp_path / "a.warc.zst").read_bytes()
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:8 + size]))
    assert dictionary.as_bytes()[:4] == op12_warc.ZSTD_DICTIONARY
    # every record opens from its place with the dictionary alone
    opener = zstandard.ZstdDecompressor(dict_data=dictionary)
    assert [opener.decompress(raw[at:at + n]) for at, n in places] == some
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in some)
    assert sum(n for _, n in places) < 0.8 * plain
    with open(tmp_path / "a.warc.zst", "rb") as f:
        read = list(op12_warc.frames(f, chunk=100))
    assert [r for _, r in read[1:]] == some and [at for at, _ in read[1:]] == [at for at, _ in places]
    assert op12_warc.parse_record(read[0][1])[0]["WARC-Type"] == "warcinfo"


def test_few_records_have_no_dictionary(tmp_path):
    places = op12_warc.write_archive(str(tmp_path), "b.warc.zst", records(2), "2024-01-01T00:00:00Z")
    with open(tmp_path / "b.warc.zst", "rb") as f:
        read = list(op12_warc.frames(f))
    assert len(places) == 2 and [r for _, r in read[1:]] == records(2)


def test_cut_or_changed_archives_are_refused(tmp_path):
    op12_warc.write_archive(str(tmp_path), "c.warc.zst", records(200), "2024-01-01T00:00:00Z")
    raw = (tmp_path / "c.warc.zst").read_bytes()
    (tmp_path / "d").write_bytes(raw[:-5])
    with open(tmp_path / "d", "rb") as f, pytest.raises(ValueError):
        list(op12_warc.frames(f))
    with pytest.raises(ValueError):     # the digest of these records is not theirs
        op12_warc.page_of(*op12_warc.parse_record(records(1)[0]))
    with pytest.raises(ValueError):
        op12_warc.parse_record(records(1)[0][:-1])


def test_archives_roll_and_long_records_stand_alone(spark, monkeypatch, tmp_path):
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3
    import pyarrow as pa
    import pyspark
    monkeypatch.setattr(pyspark, "TaskContext", Context)
    monkeypatch.setattr(op12_warc, "ARCHIVE_BYTES", 5000)
    rows = [(str(i), "u", b"x" * n, bytes([i]), "D" * 32, False, None, None) for i, n in enumerate([10, 20, 9000, 30, 2300, 2300, 2300])]
    batch = pa.RecordBatch.from_pylist([dict(zip("abcdefgh", r, strict=True)) for r in rows])
    out = pa.Table.from_batches(list(op12_warc._writer(str(tmp_path), "2024-01-01T00:00:00Z")([batch]))).to_pylist()
    assert [r["warc_page"] for r in out] == [str(i) for i in range(7)]
    files = defaultdict(list)
    for r in out:
        files[r["warc_file"]].append(r["warc_page"])
    assert list(files.values()) == [["0", "1"], ["2"], ["3", "4"], ["5"], ["6"]]      # heads take about 500 bytes
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(files)


# ---- op13 -----------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string"


def damage(rows):
    f = lambda v: " " if v is None else v
    convs = {}
    for conv, turn, role, text in rows:
        turns = convs.setdefault(conv, [])
        code = zlib.crc32(f"{f(conv)}:{f(turn)}".encode()) % 20
        x = (turn, "user" if code == 4 else f(role), "" if code == 1 else re.sub("[.!?]", "", f(text)) if code == 2 else f(text))
        turns += [] if code == 0 else [x, x] if code == 3 else [x]
    return convs


def repair(turns):
    turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, faults = set(), []
    for _, role, text in turns:
        inner = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, best = [(0, "", 0, "", ())], None
    while heap:                       # cheapest first, then ASCII-least: the first complete one is the answer
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(turns) and q in ("", "a"):
            best = (cost, audit, out)
            break
        for k, name in (("u", "user"), ("a", "assistant")):
            if k in after[q]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, k, out + (name + ":",)))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if role[:1] and role[:1] in after[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], out + (f"{role}:{text}",)))
                for k, name in (("u", "user"), ("a", "assistant")):
                    if k in after[q]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, k, out + (f"{name}:{text}",)))
    ts = [t for t, _, _ in turns if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return ((max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0), *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
            illegal, best[0], best[1], H("\n".join(best[2])))


def talks():
    import random
    rnd, rows = random.Random(3), []
    texts = ["Yes.", "No!", "why", " ", "", None, "same text.", "\n\t", "Ends here.\n ", "and then?"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    for conv in range(150):
        for turn in range(rnd.randrange(1, 8)):
            rows.append((conv, None if rnd.random() < 0.1 else turn * rnd.choice([1, 1, 2]), rnd.choice(roles), rnd.choice(texts)))
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"fine {t}.") for t in range(4)]
    rows += [(900, 1, "user", "again."), (900, 1, "user", "again."), (900, 1, "user", "again.")]         # equal rows of one turn
    rows += [(901, t, "user" if t % 2 else "assistant", "long text. " * 20_000) for t in range(2)]
    return rows


@pytest.mark.parametrize("block", [3, op13_conversations.BLOCK])
def test_repair_equals_search(spark, block):
    rows = talks()
    df = with_clashes(spark.createDataFrame(rows, TALK).repartition(5))
    got = op13_conversations.repair_report(op13_conversations.damaged(df), block=block).collect()
    want = [(conv, *repair(turns)) for conv, turns in damage(rows).items()]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_repaired_turns_hash_to_the_report(spark):
    df = op13_conversations.damaged(spark.createDataFrame(talks(), TALK))
    lines = defaultdict(list)
    for r in sorted(op13_conversations.repaired_turns(df, absent="absent").collect(), key=lambda r: r.position):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in op13_conversations.repair_report(df).collect():
        assert r.repaired_sha256 == H("\n".join(lines[r.conv_id]))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[r.conv_id]))


def test_a_conversation_over_many_batches_and_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(1, t, ("user", "assistant", "user")[t % 3], f"turn {t}." if t % 5 else f"cut {t}") for t in range(1000)]
        df = spark.createDataFrame(rows, TALK)
        spilled = op13_conversations.repair_report(df, absent=None, block=16).collect()
        assert spilled == op13_conversations.repair_report(df, absent=None).collect()
        audit = spilled[0].audit
        assert len(audit.replace("I", "")) == 1000 and spilled[0].truncated == 200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_spilled_choices_come_back_in_reverse(tmp_path):
    import os
    c = op13_conversations.Choices(str(tmp_path), 4)
    for i in range(23):
        c.add(i)
    assert len(os.listdir(tmp_path)) == 1
    assert [c.pop() for _ in range(23)] == list(range(22, -1, -1))
    c.close()
    assert os.listdir(tmp_path) == []


def test_no_turns_left_and_empty_table(spark):
    rows = [(i, t, "user", "x.") for i in range(400) for t in range(1)]
    gone = [conv for conv, turns in damage(rows).items() if not turns]
    got = {r.conv_id: r for r in op13_conversations.repair_report(op13_conversations.damaged(spark.createDataFrame(rows, TALK))).collect()}
    assert gone and len(got) == 400
    for conv in gone:
        assert tuple(got[conv])[1:] == (0, 0, 0, 0, 0, 0, "", H(""))
    none = op13_conversations.damaged(spark.createDataFrame([], TALK))
    assert op13_conversations.repair_report(none).count() == 0
