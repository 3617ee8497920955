"""DuckDB twins of the numbered operators that SQL can express."""
from __future__ import annotations

from fansignal.llm.licence_texts import KNOWN
from fansignal.llm.op10_licences import COPYRIGHT_LINE, NOT_WORD, SPELLINGS

OP7 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((max(CASE WHEN level * w <= cap THEN level END) OVER ()) * w, cap)) AS target
      FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
                                                / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP5 = r"""
WITH lower AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS w,
              array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS s FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, s, w, array_to_string(ws[s:s + w - 1], ' ') AS win
       FROM (SELECT doc_id, ws, w, unnest(generate_series(1, len(ws) - w + 1)) AS s
             FROM d, (SELECT DISTINCT w FROM iw) WHERE len(ws) >= w)),
h AS (SELECT dw.doc_id, dw.s, dw.w, iw.item_id FROM dw JOIN iw USING (w, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + w - 1)) AS p FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""



def _canonical(text: str, whole: bool) -> str:
    t = f"lower(coalesce({text}, ''))"
    if whole:
        t = f"regexp_replace({t}, '{COPYRIGHT_LINE}', '', 'g')"
    t = f"trim(regexp_replace({t}, '{NOT_WORD}', ' ', 'g'), ' ')"
    for pattern, to in SPELLINGS:
        t = f"regexp_replace({t}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"sha256(nullif({t}, ''))"


def _known() -> str:
    rows = ", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in KNOWN)
    return f"(VALUES {rows}) AS k(licence, text)"


OP10 = f"""
WITH kw AS (SELECT {_canonical('text', True)} AS digest, min(licence) AS licence FROM {_known()} GROUP BY 1),
kl AS (SELECT {_canonical('text', False)} AS digest, min(licence) AS licence FROM {_known()} GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, list_sort(list(DISTINCT licence)) AS notices, count(*) AS n
      FROM (SELECT doc_id, {_canonical('line', False)} AS digest FROM lines) JOIN kl USING (digest) GROUP BY doc_id),
d AS (SELECT doc_id, {_canonical('text', True)} AS digest FROM documents)
SELECT d.doc_id, d.digest AS text_sha256, kw.licence, coalesce(n.notices, []) AS notices, coalesce(n.n, 0)::BIGINT AS n_notice_lines
FROM d LEFT JOIN kw ON d.digest = kw.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE = {"op5_decontamination": OP5, "op7_mixing": OP7, "op10_licences": OP10}

# crc32 of a short text: the table of the reflected polynomial and its use, byte by byte.
CRC = """crc_t AS (SELECT list(c ORDER BY i) AS crc_tab FROM (SELECT i, list_reduce([i] || list_transform(range(8), lambda k: 0::BIGINT),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text; the query must have crc_t in its FROM."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return (f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda a, b: xor(a // 256, crc_tab[xor(a, b) % 256 + 1])), 4294967295)")


def _field(v: str) -> str:
    return f"coalesce(octet_length(encode(({v})::VARCHAR)) || ':' || ({v})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11 = f"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, source, {_leaf('text')} AS leaf,
        CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
      FROM documents, crc_t),
l AS (SELECT *, row_number() OVER () AS id, coalesce('1' || source, '0') AS g,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes(lvl, g, pos, n, h) AS (
  SELECT 0, g, pos, n, leaf FROM l
  UNION ALL SELECT lvl + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, g, pos // 16, n),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sub
  UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 16, n),
steps AS (SELECT lvl, g, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
            coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
          FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY lvl, g, pos // 16 ORDER BY pos)),
tsteps AS (SELECT lvl, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
            coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
          FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 16 ORDER BY pos)),
path AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, lvl) AS k, lft, rgt FROM (
  SELECT l.id, 0 AS part, s.lvl, s.lft, s.rgt FROM l JOIN steps s ON s.g = l.g AND s.pos = l.pos // (16 ** s.lvl)::BIGINT
  UNION ALL SELECT l.id, 1, t.lvl, t.lft, t.rgt FROM l JOIN sub ON sub.g = l.g JOIN tsteps t ON t.pos = sub.pos // (16 ** t.lvl)::BIGINT)),
fold(id, k, h) AS (
  SELECT id, 0::BIGINT, coalesce(tampered, leaf) FROM l
  UNION ALL SELECT fold.id, path.k, sha256(path.lft || fold.h || path.rgt) FROM fold JOIN path ON path.id = fold.id AND path.k = fold.k + 1),
last AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY id),
proof AS (SELECT id, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM path GROUP BY id),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN sub ON sub.g = l.g JOIN last USING (id) LEFT JOIN proof USING (id), root
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP12 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth,
        min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_B32}', ((('0x' || substr(hex, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> ((7 - i % 8) * 5)::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN head END AS refers_to
FROM h
"""

ORACLE |= {"op11_manifest": OP11, "op12_warc": OP12}

# op13: costs, edits and repaired lines from each place of the pattern, from the last turn back.
# Places as in the operator, counted from 1 here: 1 start, 2 after system, 3 after user, 4 after assistant.
_TO = {(1, "s"): 2, (1, "u"): 3, (2, "u"): 3, (3, "a"): 4, (4, "u"): 3}
_WANTED = {1: ("u", "user"), 2: ("u", "user"), 3: ("a", "assistant"), 4: ("u", "user")}
_STATE = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"


def _way(cost: str, edit: str, line: str | None, then: str) -> str:
    lines = f"[{line}] || {then}.o" if line else f"{then}.o"
    return f"{{'c': ({cost} + {then}.c)::BIGINT, 'a': '{edit}' || {then}.a, 'o': {lines}}}::{_STATE}"


def _turn(q: int) -> str:
    keep = " ".join(f"WHEN initial = '{r}' THEN {_way('late', 'K', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text', f's[{t}]')}"
                    for (p, r), t in _TO.items() if p == q)
    r, name = _WANTED[q]
    rerole = _way("late + 1", "R", f"'{name}:' || text", f"s[{_TO[q, r]}]")
    return (f"list_sort(list_filter([{_way('2', 'D', None, f's[{q}]')}, CASE WHEN gone THEN NULL {keep} END, "
            f"CASE WHEN NOT gone THEN {rerole} END], lambda x: x IS NOT NULL))[1]")


def _insert(q: int, s: str) -> str:
    r, name = _WANTED[q]
    return f"list_sort([{s}[{q}], {_way('5', 'I', chr(39) + name + ':' + chr(39), f'{s}[{_TO[q, r]}]')}])[1]"


_BLANK = r"[\x20\x09-\x0D]"
OP13 = rf"""
WITH RECURSIVE {CRC},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations, crc_t),
t AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, (VALUES (0), (1)) AS x(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?]{_BLANK}*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
w AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM f),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
      FROM w GROUP BY conv_id),
back(conv_id, i, s) AS (
  SELECT conv_id, last + 1, [{{'c': 0, 'a': '', 'o': []}}, {{'c': 10, 'a': 'II', 'o': ['user:', 'assistant:']}},
      {{'c': 5, 'a': 'I', 'o': ['assistant:']}}, {{'c': 0, 'a': '', 'o': []}}]::{_STATE}[] FROM counts
  UNION ALL
  SELECT conv_id, i, [{', '.join(_insert(q, 's2') for q in (1, 2, 3, 4))}] FROM (
    SELECT conv_id, i, [{', '.join(_insert(q, 's1') for q in (1, 2, 3, 4))}] AS s2 FROM (
      SELECT b.conv_id, w.i, [{', '.join(_turn(q) for q in (1, 2, 3, 4))}] AS s1
      FROM back b JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i - 1))),
best AS (SELECT conv_id, s[1] AS x FROM back WHERE i = 1)
SELECT convs.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(array_to_string(x.o, chr(10)), '')) AS repaired_sha256
FROM convs LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM convs.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM convs.conv_id
"""

ORACLE["op13_conversations"] = OP13
