"""Oracle SQL (DuckDB) for each registered query, written from the operator definitions."""
from __future__ import annotations

from fansignal.plans.oracle_views import (AS_OF, EVENTS_V, MATCHES_V, POST_ENTITIES_V, POSTS_V,
                                          TEAMS_V, TEXTS_V, fx, with_views)

ALL_HOURS = 24 * 31


def _spikes(bucket: str) -> str:
    return with_views(POSTS_V, POST_ENTITIES_V) + f"""
p AS (SELECT * FROM posts_v WHERE "timestamp" >= {AS_OF} - INTERVAL {ALL_HOURS} HOUR AND "timestamp" <= {AS_OF}),
b AS (SELECT time_bucket(INTERVAL '{bucket}', "timestamp") AS bucket, avg(sentiment_score) AS avg_score,
        count(*) AS doc_count,
        count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
        count(*) FILTER (WHERE sentiment_label = 'negative') AS negative,
        count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral
      FROM p GROUP BY 1),
s AS (SELECT avg(avg_score) AS mu, stddev_pop(avg_score) AS sigma, count(*) AS n FROM b WHERE avg_score IS NOT NULL),
sp AS (SELECT b.*, s.mu, s.sigma FROM b, s WHERE s.n >= 3 AND abs(b.avg_score - s.mu) > 2 * s.sigma),
ec AS (SELECT time_bucket(INTERVAL '{bucket}', e."timestamp") AS bucket, name, count(*) AS n
       FROM post_entities_v e WHERE e."timestamp" >= {AS_OF} - INTERVAL {ALL_HOURS} HOUR AND e."timestamp" <= {AS_OF}
       GROUP BY 1, 2),
er AS (SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, name) AS rk FROM ec),
te AS (SELECT bucket, string_agg(name, ', ' ORDER BY rk) AS top_entities FROM er WHERE rk <= 5 GROUP BY bucket)
SELECT sp.bucket AS "timestamp",
  CASE WHEN sp.avg_score > sp.mu THEN 'positive' ELSE 'negative' END AS direction,
  {fx('sp.avg_score', 4)} AS avg_score,
  {fx('CASE WHEN sp.sigma > 0 THEN abs(sp.avg_score - sp.mu) / sp.sigma ELSE 0 END', 2)} AS deviation_sigmas,
  sp.doc_count AS post_count, sp.positive, sp.negative, sp.neutral,
  coalesce(te.top_entities, '') AS top_entities
FROM sp LEFT JOIN te ON te.bucket = sp.bucket"""


ORACLE = {
    "g08_spikes": _spikes("1 hour"),
    "g08_spikes_15m": _spikes("15 minutes"),
}

from fansignal.plans.oracle_views import (ADV_V, ARRAYS_V, PLAYER_EVENTS_V, TEAM_FEATURES_V,  # noqa: E402
                                          TEAM_ROWS_V)

M = with_views(TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V)
FEAT = with_views(TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V, TEAM_ROWS_V, TEAM_FEATURES_V)
PLAY = with_views(TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V, PLAYER_EVENTS_V)
ADV_COLS = ["xg", "xga", "xg_difference", "avg_possession", "avg_shots_on_target", "shot_accuracy",
            "avg_pass_accuracy", "avg_corners", "avg_saves", "ppda", "progressive_passes",
            "progressive_carries", "pressures"]

SNAPS = M + """snap AS (
  SELECT m.match_id, m.utc_date + to_minutes(CAST(30 * k AS BIGINT)) AS snapshot_ts, k,
    (SELECT count(*) FROM goals_v g WHERE g.match_id = m.match_id AND g.minute <= 30 * k) AS n_goals,
    (SELECT count(*) FROM cards_v c WHERE c.match_id = m.match_id AND c.minute <= 30 * k) AS n_cards
  FROM matches_w m, (VALUES (1), (2), (3)) AS ks(k) WHERE m.status IN ('FINISHED', 'LIVE'))
"""

EVENT_ROWS = """ev AS (
  SELECT 'goal' AS event_type, match_id, pos, minute, team, scorer, assist, type,
         CAST(NULL AS VARCHAR) AS player, CAST(NULL AS VARCHAR) AS card, status FROM goals_v
  UNION ALL
  SELECT 'card', match_id, pos, minute, team, NULL, NULL, NULL, player, card, status FROM cards_v)
"""

ORACLE.update({
    "c01_status_map": with_views(TEAMS_V) + """x AS (SELECT 1)
      SELECT CASE o_orderstatus WHEN 'F' THEN 'FT' WHEN 'O' THEN 'NS' ELSE '1H' END AS short, status,
             count(*) AS fixtures FROM teams_v GROUP BY ALL""",
    "c02_matches": M + """x AS (SELECT 1)
      SELECT m.match_id, m.status, m.stage, m.utc_date, m.home_team, m.away_team, m.home_score_ft, m.away_score_ft,
        m.home_score_ht, m.away_score_ht, m.winner,
        CAST((SELECT count(*) FROM goals_v g WHERE g.match_id = m.match_id) AS INTEGER) AS n_goals,
        CAST((SELECT count(*) FROM cards_v c WHERE c.match_id = m.match_id) AS INTEGER) AS n_cards,
        CAST((SELECT count(*) FROM subs_v s WHERE s.match_id = m.match_id) AS INTEGER) AS n_subs
      FROM matches_w m""",
    "c03_goals": M + """x AS (SELECT 1)
      SELECT match_id, CAST(pos AS INTEGER) AS pos, minute, team, scorer, assist, type FROM goals_v""",
    "c04_cards": M + """x AS (SELECT 1)
      SELECT match_id, CAST(pos AS INTEGER) AS pos, minute, team, player, card FROM cards_v""",
    "c05_substitutions": M + """x AS (SELECT 1)
      SELECT match_id, CAST(pos AS INTEGER) AS pos, minute, team, player_out, player_in FROM subs_v""",
    "c07_normalize_match": M + """x AS (SELECT 1)
      SELECT match_id, home_team, away_team, coalesce(home_score_ft, 0) AS home_score_ft,
        coalesce(away_score_ft, 0) AS away_score_ft, coalesce(home_score_ht, 0) AS home_score_ht,
        coalesce(away_score_ht, 0) AS away_score_ht,
        (upper(stage) LIKE '%EXTRA_TIME%' OR upper(stage) LIKE '%AET%' OR upper(stage) LIKE '%ET%') AS went_to_et,
        (upper(stage) LIKE '%PENALTY%' OR upper(stage) LIKE '%PEN%' OR upper(stage) LIKE '%SHOOTOUT%') AS went_to_pens,
        CASE WHEN contains(upper(stage), 'ROUND_OF_16') OR contains(upper(stage), 'QUARTER_FINALS')
               OR contains(upper(stage), 'SEMI_FINALS') OR contains(upper(stage), 'FINAL')
               OR contains(upper(stage), 'THIRD_PLACE') THEN 1.5 ELSE 1.0 END AS stage_weight,
        CASE WHEN contains(upper(stage), 'ROUND_OF_16') OR contains(upper(stage), 'QUARTER')
               OR contains(upper(stage), 'SEMI') OR contains(upper(stage), 'FINAL') THEN 1.5 ELSE 1.0 END
          AS stage_weight_engineer,
        CASE WHEN list_bool_or([contains(regexp_replace(upper(stage), '[ -]+', '_', 'g'), s)
               FOR s IN ['ROUND_OF_16', 'QUARTER_FINALS', 'SEMI_FINALS', 'FINAL', 'THIRD_PLACE']])
             THEN 1.5 ELSE 1.0 END AS stage_weight_normalized
      FROM matches_w""",
    "a08_finished": M + "x AS (SELECT 1) SELECT match_id, utc_date, home_team, away_team FROM matches_w WHERE status = 'FINISHED'",
    "a09_scheduled": M + "x AS (SELECT 1) SELECT match_id, utc_date, home_team, away_team FROM matches_w WHERE status IN ('SCHEDULED', 'TIMED')",
    "a10_live": with_views(TEAMS_V) + "x AS (SELECT 1) SELECT o_orderkey AS match_id, '1H' AS short FROM teams_v WHERE o_orderstatus = 'P'",
    "a11_by_status": with_views(TEAMS_V) + "x AS (SELECT 1) SELECT o_orderkey AS match_id FROM teams_v WHERE o_orderstatus = 'F'",
    "a06_upsert_latest": SNAPS + """SELECT match_id, snapshot_ts, CAST(n_goals AS INTEGER) AS n_goals,
        CAST(n_cards AS INTEGER) AS n_cards FROM snap WHERE k = 3""",
    "b11_snapshot_changes": SNAPS + """, d AS (SELECT *, coalesce(lag(n_goals) OVER (PARTITION BY match_id ORDER BY k), 0) AS pg,
        coalesce(lag(n_cards) OVER (PARTITION BY match_id ORDER BY k), 0) AS pc FROM snap)
      SELECT match_id, snapshot_ts, CAST(n_goals AS INTEGER) AS n_goals, CAST(n_cards AS INTEGER) AS n_cards
      FROM d WHERE n_goals > pg OR n_cards > pc""",
    "b12_event_fanout": M + EVENT_ROWS + """SELECT event_type, match_id, CAST(pos AS INTEGER) AS pos, minute, team,
        scorer, assist, type, player, card FROM ev WHERE status = 'FINISHED'""",
    "b13_new_events": M + EVENT_ROWS + """, cur AS (SELECT * FROM ev WHERE minute <= 90),
      prev AS (SELECT * FROM ev WHERE minute <= 60)
      SELECT event_type, match_id, CAST(pos AS INTEGER) AS pos, minute, team, scorer, assist, type, player, card
      FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.match_id = c.match_id
        AND p.event_type = c.event_type AND p.minute IS NOT DISTINCT FROM c.minute
        AND p.team IS NOT DISTINCT FROM c.team AND p.scorer IS NOT DISTINCT FROM c.scorer
        AND p.player IS NOT DISTINCT FROM c.player AND p.type IS NOT DISTINCT FROM c.type
        AND p.card IS NOT DISTINCT FROM c.card)""",
    "i01_team_rows": FEAT + """x AS (SELECT 1) SELECT match_id, team, side, CAST(gf AS INTEGER) AS gf, CAST(ga AS INTEGER) AS ga,
        CAST(ht_for AS INTEGER) AS ht_for, CAST(ht_against AS INTEGER) AS ht_against, points,
        CAST(cards AS INTEGER) AS cards, CAST(event_goals AS INTEGER) AS event_goals FROM team_rows_v""",
    "i03_recency_weights": FEAT + f"x AS (SELECT 1) SELECT team, match_id, {fx('weight', 9)} AS weight FROM team_rows_w",
    "i04_team_features": FEAT + f"""x AS (SELECT 1) SELECT team, matches_played, {fx('form_score')} AS form_score,
        {fx('avg_goals_scored')} AS avg_goals_scored, {fx('avg_goals_conceded')} AS avg_goals_conceded,
        {fx('goal_difference')} AS goal_difference, {fx('clean_sheet_rate')} AS clean_sheet_rate, comeback_wins,
        {fx('avg_cards')} AS avg_cards, {fx('avg_event_goals')} AS avg_event_goals, {fx('total_points')} AS total_points,
        """ + ", ".join(f"0.0::DOUBLE AS {c}" for c in ADV_COLS) + " FROM team_features_v",
    "i11_merge_advanced": FEAT[:-2] + ",\n" + ADV_V + f""",
      pick AS (SELECT t.team, a.*, row_number() OVER (PARTITION BY t.team ORDER BY CASE WHEN a.team = t.team THEN 0 ELSE 1 END,
                 a.team) AS rn
               FROM team_features_v t JOIN adv_v a ON lower(a.team) = lower(t.team))
      SELECT t.team, t.matches_played, {fx('t.form_score')} AS form_score,
        {fx('coalesce(p.xg, 0.0)')} AS xg, {fx('coalesce(p.xga, 0.0)')} AS xga,
        {fx('coalesce(p.xg, 0.0) - coalesce(p.xga, 0.0)')} AS xg_difference,
        {fx('coalesce(p.possession_pct, 0.0)')} AS avg_possession, 0.0::DOUBLE AS avg_shots_on_target,
        0.0::DOUBLE AS shot_accuracy, 0.0::DOUBLE AS avg_pass_accuracy, 0.0::DOUBLE AS avg_corners,
        0.0::DOUBLE AS avg_saves, {fx('coalesce(p.ppda, 0.0)')} AS ppda,
        {fx('coalesce(p.progressive_passes, 0.0)')} AS progressive_passes,
        {fx('coalesce(p.progressive_carries, 0.0)')} AS progressive_carries,
        {fx('coalesce(p.pressures, 0.0)')} AS pressures
      FROM team_features_v t LEFT JOIN (SELECT * FROM pick WHERE rn = 1) p ON p.team = t.team""",
    "i12_player_features": PLAY + f"""x AS (SELECT 1) SELECT player, team, goals, assists, yellow_cards, red_cards, matches,
        {fx('goals_per_match')} AS goals_per_match, {fx('goal_contributions_per_match')} AS goal_contributions_per_match
        FROM player_features_v""",
    "i17_top_players": PLAY + f"""x AS (SELECT 1) SELECT team, rank, player, goals, assists,
        {fx('goal_contributions_per_match')} AS goal_contributions_per_match FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY goal_contributions_per_match DESC, player) AS INTEGER) AS rank
        FROM player_features_v WHERE team IS NOT NULL) WHERE rank <= 3""",
    "i18_standings": FEAT + """x AS (SELECT 1), g AS (SELECT stage, team, count(*) AS played,
        count(*) FILTER (WHERE points = 3) AS won, count(*) FILTER (WHERE points = 1) AS drawn,
        count(*) FILTER (WHERE points = 0) AS lost, CAST(sum(gf) AS BIGINT) AS goals_for,
        CAST(sum(ga) AS BIGINT) AS goals_against, CAST(sum(points) AS BIGINT) AS pts FROM team_rows_v GROUP BY ALL)
      SELECT *, goals_for - goals_against AS goal_diff,
        CAST(rank() OVER (PARTITION BY stage ORDER BY pts DESC, goals_for - goals_against DESC, goals_for DESC) AS INTEGER) AS position
      FROM g""",
    "i19_top_scorers": PLAY + """x AS (SELECT 1) SELECT player, team, goals, assists FROM player_features_v
        ORDER BY goals DESC, assists DESC, player LIMIT 20""",
})

from fansignal.functions.text import SLANG_RULES  # noqa: E402

T = with_views(TEXTS_V)
EMOJI_SQL = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F9FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"


def _slang_sql(expr: str) -> str:
    for pat, rep in SLANG_RULES:
        expr = f"regexp_replace({expr}, '(?i){pat}', '{rep}', 'g')"
    return expr


def _strip_ws(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _words(e):
    return f"CASE WHEN {_strip_ws(e)} = '' THEN 0 ELSE len(string_split_regex({_strip_ws(e)}, '\\s+')) END"


def _letter_ratio(e):
    return f"length(regexp_replace({e}, '[^\\p{{L}}]', '', 'g')) / greatest(length({e}), 1)"


def _clean_sql(e="text"):
    t = f"regexp_replace({e}, '&[a-zA-Z]+;|&#\\d+;', ' ', 'g')"
    t = f"regexp_replace({t}, 'https?://\\S+|www\\.\\S+', '', 'g')"
    t = f"regexp_replace({t}, '@[\\p{{L}}\\p{{N}}_]+', '', 'g')"
    t = f"replace({t}, '#', '')"
    t = f"strip_accents({t})"
    t = f"regexp_replace({t}, '{EMOJI_SQL}', ' ', 'g')"
    t = _slang_sql(t)
    t = _strip_ws(f"regexp_replace({t}, '\\s{{2,}}', ' ', 'g')")
    return t


CLEAN = T + f"""c0 AS (SELECT doc_id, lang, author, text, {_clean_sql()} AS t FROM texts_v),
c AS (SELECT doc_id, lang, CASE WHEN text IS NULL OR text = '' THEN NULL
        WHEN {_words('t')} >= 4 AND {_letter_ratio('t')} >= 0.4 THEN t END AS text_clean FROM c0)
"""

# Texts of fewer than three words with a run of nine equal characters (of any but line breaks): islands of
# equal neighbours share the difference of two row numbers.
REPEATED = f"""few AS (SELECT doc_id, coalesce(text, '') AS t FROM texts_v WHERE {_words("coalesce(text, '')")} < 3),
ch AS (SELECT doc_id, i, substr(t, i, 1) AS c FROM (SELECT doc_id, t, unnest(generate_series(1, length(t))) AS i FROM few)),
isl AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch WHERE c NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233))),
repeated AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM isl GROUP BY doc_id, c, g HAVING count(*) >= 9))
"""

ORACLE.update({
    "d02_html_entities": T + "x AS (SELECT 1) SELECT doc_id, regexp_replace(text, '&[a-zA-Z]+;|&#\\d+;', ' ', 'g') AS text_out FROM texts_v",
    "d03_urls": T + "x AS (SELECT 1) SELECT doc_id, regexp_replace(text, 'https?://\\S+|www\\.\\S+', '', 'g') AS text_out FROM texts_v",
    "d04_mentions": T + "x AS (SELECT 1) SELECT doc_id, regexp_replace(text, '@[\\p{L}\\p{N}_]+', '', 'g') AS text_out FROM texts_v",
    "d05_hashtags": T + "x AS (SELECT 1) SELECT doc_id, replace(text, '#', '') AS text_out FROM texts_v",
    "d06_strip_accents": T + "x AS (SELECT 1) SELECT doc_id, strip_accents(text) AS text_out FROM texts_v",
    "d07_emoji": T + f"x AS (SELECT 1) SELECT doc_id, regexp_replace(text, '{EMOJI_SQL}', ' ', 'g') AS text_out FROM texts_v",
    "d08_slang": T + f"x AS (SELECT 1) SELECT doc_id, {_slang_sql('strip_accents(text)')} AS text_out FROM texts_v",
    "d09_whitespace": T + f"x AS (SELECT 1) SELECT doc_id, {_strip_ws("regexp_replace(text, '\\s{2,}', ' ', 'g')")} AS text_out FROM texts_v",
    "d10_word_filter": T + f"x AS (SELECT 1) SELECT doc_id, CAST({_words('text')} AS INTEGER) AS words FROM texts_v WHERE {_words('text')} >= 4",
    "d11_letter_ratio": T + f"x AS (SELECT 1) SELECT doc_id, {fx(_letter_ratio('text'), 9)} AS letter_ratio FROM texts_v WHERE {_letter_ratio('text')} >= 0.4",
    "d12_clean_text": CLEAN + "SELECT doc_id, text_clean FROM c WHERE text_clean IS NOT NULL",
    "d13_bot_author": with_views(POSTS_V) + "x AS (SELECT 1) SELECT post_id, author FROM posts_v WHERE regexp_matches(author, '(?i)bot$|^auto|^mod|_bot$|newsbot|feedbot')",
    "d14_low_score": with_views(POSTS_V) + "x AS (SELECT 1) SELECT post_id, score FROM posts_v WHERE score < -10",
    "d15_repeated_chars": T + REPEATED + "SELECT doc_id FROM texts_v JOIN repeated USING (doc_id)",
    "d16_spam": T + REPEATED + """SELECT doc_id FROM texts_v LEFT JOIN repeated r USING (doc_id)
        WHERE regexp_matches(coalesce(author, ''), '(?i)bot$|^auto|^mod|_bot$|newsbot|feedbot') OR doc_id % 40 - 25 < -10 OR r.doc_id IS NOT NULL""",
    "d17_language": CLEAN + """SELECT lang, CASE WHEN length(regexp_replace(text_clean, '[^A-Za-z]', '', 'g')) / greatest(length(text_clean), 1) > 0.7
        THEN 'en' ELSE 'other' END AS detected, count(*) AS docs FROM c WHERE text_clean IS NOT NULL GROUP BY ALL""",
    "d18_tokens": T + """x AS (SELECT 1), tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda x: x <> '') AS t FROM texts_v)
      SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM tk""",
    "d19_truncate": T + "x AS (SELECT 1) SELECT doc_id, substring(text, 1, 1000) AS text_out FROM texts_v",
    "b01_relevance": T + """x AS (SELECT 1) SELECT doc_id FROM texts_v WHERE contains(lower(text), 'world cup') OR contains(lower(text), 'worldcup')
        OR contains(lower(text), 'fifa') OR contains(lower(text), 'worldcup2026')""",
    "b04_track_rule": T + """x AS (SELECT 1) SELECT doc_id FROM texts_v WHERE regexp_matches(text, '(?i)#(worldcup2026|fifaworldcup|worldcup)\\b') AND lang = 'en'""",
})

# De-duplication, brute force over the documents table.
SH = """x AS (SELECT 1),
w AS (SELECT doc_id, CASE WHEN regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') = '' THEN []::VARCHAR[]
        ELSE string_split_regex(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+') END AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 3 THEN w
        ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
ut AS (SELECT DISTINCT doc_id, unnest(s) AS t FROM sh),
ns AS (SELECT doc_id, len(s) AS n, list_sort(s) AS ss FROM sh)
"""

NEAR = SH + """, reps AS (SELECT min(doc_id) AS doc_id FROM ns WHERE n > 0 GROUP BY ss),
rt AS (SELECT ut.* FROM ut JOIN reps USING (doc_id)),
inter AS (SELECT a.doc_id AS earlier_id, b.doc_id AS later_id, count(*) AS i
          FROM rt a JOIN rt b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT earlier_id, later_id, i / (na.n + nb.n - i) AS jaccard FROM inter
          JOIN ns na ON na.doc_id = earlier_id JOIN ns nb ON nb.doc_id = later_id
          WHERE i / (na.n + nb.n - i) >= 0.8 - 1e-9)
"""

ORACLE.update({
    "e01_shingles": "WITH " + SH[len("x AS (SELECT 1),\n"):] + "SELECT doc_id, CAST(n AS INTEGER) AS n_shingles FROM ns",
    "e02_jaccard_adjacent": "WITH " + SH[len("x AS (SELECT 1),\n"):] + f""", pr AS (
        SELECT a.doc_id, a.n AS na, b.n AS nb,
          (SELECT count(*) FROM ut x JOIN ut y ON x.t = y.t WHERE x.doc_id = a.doc_id AND y.doc_id = b.doc_id) AS i
        FROM ns a JOIN ns b ON b.doc_id = a.doc_id + 1)
      SELECT doc_id, {fx('CASE WHEN na + nb - i = 0 THEN 0.0 ELSE i / (na + nb - i) END')} AS jaccard FROM pr""",
    "e03_near_dup_pairs": "WITH " + NEAR[len("x AS (SELECT 1),\n"):] + f"SELECT earlier_id, later_id, {fx('jaccard')} AS jaccard FROM pairs",
    "e05_keep_first": "WITH " + NEAR[len("x AS (SELECT 1),\n"):] + """, firsts AS (SELECT min(doc_id) AS doc_id FROM ns GROUP BY ss, CASE WHEN n = 0 THEN doc_id END)
      SELECT doc_id FROM firsts WHERE doc_id NOT IN (SELECT later_id FROM pairs)""",
    "e07_exact_dups": "WITH " + SH[len("x AS (SELECT 1),\n"):] + """, g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY ss, CASE WHEN n = 0 THEN doc_id END) AS rep_id FROM ns)
      SELECT doc_id, rep_id FROM g WHERE doc_id <> rep_id""",
})

from fansignal.functions.scoring import NEGATIVE_WORDS, POSITIVE_WORDS  # noqa: E402

LEX = "lex(word, pol) AS (VALUES " + ", ".join(
    [f"('{w}', 1)" for w in POSITIVE_WORDS] + [f"('{w}', -1)" for w in NEGATIVE_WORDS]) + ")"

TP = with_views(TEXTS_V, TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V) + LEX + """,
tp AS (SELECT doc_id AS post_id, ts AS "timestamp", source, text FROM texts_v),
ltok AS (SELECT post_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda x: x <> '')) AS t FROM tp),
lsc AS (SELECT post_id, count(*) AS hits, sum(pol) AS pol FROM ltok JOIN lex ON lex.word = ltok.t GROUP BY post_id),
scored AS (SELECT tp.*, CASE WHEN coalesce(pol, 0) > 0 THEN 'positive' WHEN coalesce(pol, 0) < 0 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN coalesce(hits, 0) > 0 THEN 0.5 + 0.5 * pol / hits ELSE 0.5 END AS sentiment_score
  FROM tp LEFT JOIN lsc USING (post_id)),
teams AS (SELECT DISTINCT home_team AS team FROM matches_w UNION SELECT DISTINCT away_team FROM matches_w),
ttok AS (SELECT DISTINCT post_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS t FROM tp),
pairs AS (SELECT DISTINCT ttok.post_id, teams.team FROM ttok JOIN teams ON lower(teams.team) = ttok.t),
side AS (SELECT match_id, utc_date, home_team AS team FROM matches_w UNION ALL SELECT match_id, utc_date, away_team FROM matches_w),
near AS (SELECT post_id, match_id, utc_date, row_number() OVER (PARTITION BY post_id ORDER BY
           abs(epoch(tp."timestamp") - epoch(side.utc_date)), match_id) AS rn
         FROM pairs JOIN side USING (team) JOIN tp USING (post_id)),
assigned AS (SELECT s.*, n.match_id,
  CASE WHEN n.utc_date IS NULL THEN 'unknown'
       WHEN (epoch(s."timestamp") - epoch(n.utc_date)) / 3600.0 < -2 THEN 'pre_match'
       WHEN (epoch(s."timestamp") - epoch(n.utc_date)) / 3600.0 > 3 THEN 'post_match' ELSE 'live' END AS match_phase
  FROM scored s LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING (post_id))
"""

# H03 in the hours before its time; to follow TP or SCORED_PAIRS.
TEAM_SENTIMENT = """, agg AS (SELECT team, avg(sentiment_score) AS a, count(sentiment_label) AS n,
    count(*) FILTER (WHERE sentiment_label = 'positive') AS pos, count(*) FILTER (WHERE sentiment_label = 'negative') AS neg
  FROM pairs JOIN scored USING (post_id)
  WHERE "timestamp" >= TIMESTAMP '2024-01-01 04:00:00' AND "timestamp" <= TIMESTAMP '2024-01-01 12:00:00' GROUP BY team),
sentiment_v AS (SELECT team, coalesce(CASE WHEN a <> 0 THEN a END, 0.5) AS avg_sentiment, coalesce(n, 0) AS post_count,
    coalesce(pos, 0) / greatest(coalesce(n, 0), 1) AS positive_ratio, coalesce(neg, 0) / greatest(coalesce(n, 0), 1) AS negative_ratio
  FROM teams LEFT JOIN agg USING (team))
"""
SCORED_PAIRS = LEX + TP.split(LEX)[1].split(",\nside AS")[0]

PB = with_views(POSTS_V, POST_ENTITIES_V)
RANGE = f'"timestamp" >= {AS_OF} - INTERVAL {ALL_HOURS} HOUR AND "timestamp" <= {AS_OF}'
ENG = "least(5.0, 1.0 + ln(1 + greatest(coalesce(score, 0) + coalesce(like_count, 0), 0)) / 5.0)"
DECAY = f"pow(0.5, (epoch({AS_OF}) - epoch(\"timestamp\")) / 60.0 / 30.0)"

ORACLE.update({
    "f01_decay_weight": PB + f"x AS (SELECT 1) SELECT post_id, {fx(DECAY, 9)} AS weight FROM posts_v",
    "f02_engagement_weight": PB + f"x AS (SELECT 1) SELECT post_id, {fx(ENG)} AS weight FROM posts_v",
    "f04_assign_matches": TP + "SELECT post_id, match_id, match_phase FROM assigned",
    "f06_lexicon_score": TP + f"SELECT post_id, sentiment_label, {fx('sentiment_score')} AS sentiment_score FROM scored",
    "f11_entity_filter": PB + """x AS (SELECT 1) SELECT post_id, 2 AS n_entities,
        'TEAM_' || (user_id % 25) || ':ORG:0.9|PLAYER_' || user_id || ':PER:0.8' AS entities FROM posts_v""",
    "f12_gazetteer": TP + """, gz AS (SELECT post_id, t, min(pos) AS pos FROM (
          SELECT post_id, generate_subscripts(tk, 1) AS pos, unnest(tk) AS t FROM (
            SELECT post_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS tk FROM tp))
          GROUP BY ALL)
      SELECT post_id, string_agg(teams.team, ',' ORDER BY pos) AS entities FROM gz JOIN teams ON lower(teams.team) = gz.t GROUP BY post_id""",
    "f14_aggregate_sentiment": PB + f"""x AS (SELECT 1), w AS (SELECT *, {DECAY} * {ENG} AS w FROM posts_v)
      SELECT source, {fx('avg(sentiment_score)')} AS avg_sentiment,
        {fx('CASE WHEN sum(w) <> 0 THEN sum(sentiment_score * w) / sum(w) ELSE 0.5 END')} AS weighted_sentiment,
        {fx("count(*) FILTER (WHERE sentiment_label = 'positive') / count(*)")} AS positive_ratio,
        {fx("count(*) FILTER (WHERE sentiment_label = 'negative') / count(*)")} AS negative_ratio,
        {fx("count(*) FILTER (WHERE sentiment_label = 'neutral') / count(*)")} AS neutral_ratio,
        count(*) AS post_count FROM w GROUP BY source""",
    "f15_phase_breakdown": TP + f"""SELECT source, match_phase AS phase, {fx('avg(sentiment_score)')} AS avg, count(*) AS count
        FROM assigned GROUP BY ALL""",
    "f17_thread_sample": TP + """, r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY "timestamp", post_id) AS rk
        FROM assigned WHERE match_id IS NOT NULL)
      SELECT match_id, string_agg('- ' || text, chr(10) ORDER BY rk) AS sample,
        CAST(length(string_agg('- ' || text, chr(10) ORDER BY rk)) AS INTEGER) AS sample_chars,
        count(*) AS posts FROM r WHERE rk <= 30 GROUP BY match_id""",
    "g02_histogram": PB + f"""x AS (SELECT 1) SELECT time_bucket(INTERVAL '15 minutes', "timestamp") AS bucket,
        {fx('avg(sentiment_score)')} AS avg_score, count(*) AS doc_count,
        count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
        count(*) FILTER (WHERE sentiment_label = 'negative') AS negative,
        count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(sentiment_label) AS post_count
      FROM posts_v WHERE {RANGE} GROUP BY 1""",
    "g03_gap_fill": PB + f"""x AS (SELECT 1), b AS (SELECT time_bucket(INTERVAL '15 minutes', "timestamp") AS bucket,
        avg(sentiment_score) AS avg_score, count(*) AS doc_count,
        count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
        count(*) FILTER (WHERE sentiment_label = 'negative') AS negative,
        count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(sentiment_label) AS post_count
      FROM posts_v WHERE {RANGE} GROUP BY 1),
      g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL '15 minutes')) AS bucket FROM b)
      SELECT g.bucket, {fx('b.avg_score')} AS avg_score, coalesce(doc_count, 0) AS doc_count, coalesce(positive, 0) AS positive,
        coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(post_count, 0) AS post_count
      FROM g LEFT JOIN b USING (bucket)""",
    "g05_top_entities": PB + f"""x AS (SELECT 1), c AS (SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS bucket, name, count(*) AS n
        FROM post_entities_v WHERE {RANGE} GROUP BY 1, 2)
      SELECT * FROM (SELECT bucket, name, n, CAST(row_number() OVER (PARTITION BY bucket ORDER BY n DESC, name) AS INTEGER) AS rank FROM c)
      WHERE rank <= 5""",
    "g07_timeline": PB + f"""x AS (SELECT 1), b AS (SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS bucket,
        avg(sentiment_score) AS avg_score, count(*) AS doc_count,
        count(*) FILTER (WHERE sentiment_label = 'positive') AS positive,
        count(*) FILTER (WHERE sentiment_label = 'negative') AS negative,
        count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral, count(sentiment_label) AS post_count
      FROM posts_v WHERE {RANGE} GROUP BY 1),
      c AS (SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS bucket, name, count(*) AS n FROM post_entities_v WHERE {RANGE} GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, name) AS rk FROM c),
      te AS (SELECT bucket, string_agg(name, ', ' ORDER BY rk) AS top_entities FROM r WHERE rk <= 5 GROUP BY bucket)
      SELECT b.bucket AS "timestamp", {fx('avg_score')} AS avg_sentiment, doc_count, post_count, positive, negative, neutral,
        coalesce(top_entities, '') AS top_entities FROM b LEFT JOIN te USING (bucket) WHERE avg_score IS NOT NULL""",
    "g12_label_distribution": PB + """x AS (SELECT 1) SELECT sentiment_label, count(*) AS posts FROM posts_v GROUP BY 1
        ORDER BY posts DESC, sentiment_label LIMIT 3""",
    "g13_post_volume": PB + """x AS (SELECT 1) SELECT time_bucket(INTERVAL '15 minutes', "timestamp") AS bucket, count(*) AS posts
        FROM posts_v GROUP BY 1""",
    "g14_sentiment_by_source": PB + f"""x AS (SELECT 1), top AS (SELECT source FROM posts_v GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)
      SELECT time_bucket(INTERVAL '1 hour', "timestamp") AS bucket, source, {fx('avg(sentiment_score)')} AS avg_sentiment,
        count(*) AS posts FROM posts_v WHERE source IN (SELECT source FROM top) GROUP BY 1, 2""",
    "g15_sentiment_over_time": PB + f"""x AS (SELECT 1) SELECT time_bucket(INTERVAL '15 minutes', "timestamp") AS bucket,
        {fx('avg(sentiment_score)')} AS avg_sentiment FROM posts_v GROUP BY 1""",
    "h01_mentions_team": T + """x AS (SELECT 1) SELECT doc_id FROM texts_v
        WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), 'team_3')""",
    "h02_post_team_pairs": TP + "SELECT post_id, team FROM pairs",
    "g01_time_range": PB + """x AS (SELECT 1) SELECT post_id, "timestamp" FROM posts_v
        WHERE "timestamp" >= TIMESTAMP '2024-01-14 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-16 00:00:00'""",
    "h03_team_sentiment": TP + f""", agg AS (SELECT team, avg(sentiment_score) AS a, count(sentiment_label) AS n,
        count(*) FILTER (WHERE sentiment_label = 'positive') AS pos, count(*) FILTER (WHERE sentiment_label = 'negative') AS neg
        FROM pairs JOIN scored USING (post_id) GROUP BY team)
      SELECT team, {fx('coalesce(CASE WHEN a <> 0 THEN a END, 0.5)')} AS avg_sentiment, coalesce(n, 0) AS post_count,
        {fx('coalesce(pos, 0) / greatest(coalesce(n, 0), 1)')} AS positive_ratio,
        {fx('coalesce(neg, 0) / greatest(coalesce(n, 0), 1)')} AS negative_ratio
      FROM teams LEFT JOIN agg USING (team)""",
})

_SP = _spikes("1 hour")
_SP_BODY = _SP[_SP.index("p AS (SELECT"):_SP.index("SELECT sp.bucket")]


def _detail(who: str, alias: str) -> str:
    return (f"coalesce({who}, 'None') || ' (' || coalesce({alias}.team, 'None') || ') ' || "
            f"coalesce(CAST({alias}.minute AS VARCHAR), 'None') || chr(39)")


ORACLE["g10_events_near"] = with_views(POSTS_V, POST_ENTITIES_V, TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V) + _SP_BODY.rstrip().rstrip(",") + f""",
mm AS (SELECT DISTINCT sp.bucket AS spike_ts, m.match_id, m.home_team || ' vs ' || m.away_team AS match
       FROM sp JOIN matches_w m ON m.utc_date >= sp.bucket - INTERVAL 30 MINUTE AND m.utc_date <= sp.bucket + INTERVAL 30 MINUTE),
ev AS (SELECT mm.spike_ts, mm.match_id, mm.match, CAST(g.pos AS INTEGER) AS pos, 'GOAL' AS type, {_detail('g.scorer', 'g')} AS detail
       FROM mm JOIN goals_v g USING (match_id)
       UNION ALL
       SELECT mm.spike_ts, mm.match_id, mm.match, CAST(c.pos AS INTEGER), coalesce(c.card, 'CARD'), {_detail('c.player', 'c')}
       FROM mm JOIN cards_v c USING (match_id))
SELECT *, CASE WHEN type = 'GOAL' THEN 'goal' WHEN contains(type, 'YELLOW') THEN 'yellow' ELSE 'red' END AS marker FROM ev"""

# ---- outcome model ------------------------------------------------------------
from fansignal.operators.model import FEATURE_NAMES  # noqa: E402

FIXTURE_STATS = """g AS (SELECT l_orderkey, l_suppkey % 2 AS side, l_linenumber, CAST(trunc(max(l_quantity)) AS INTEGER) AS q
      FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY ALL),
fs AS (SELECT g.l_orderkey AS fixture_id, CASE WHEN side = 0 THEN t.home ELSE t.away END AS team, l_linenumber AS ln,
         CASE WHEN g.l_orderkey % 17 = 0 THEN (CASE WHEN side = 0 THEN NULL ELSE 'n/a' END)
              WHEN l_linenumber = 1 THEN q || '%' WHEN l_linenumber = 5 THEN CAST(q + 40 AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS value
       FROM g JOIN teams_v t ON t.o_orderkey = g.l_orderkey),
wide AS (SELECT fixture_id, team,
  max(CASE WHEN ln = 1 THEN value END) AS v1, max(CASE WHEN ln = 2 THEN value END) AS v2, max(CASE WHEN ln = 3 THEN value END) AS v3,
  max(CASE WHEN ln = 4 THEN value END) AS v4, max(CASE WHEN ln = 5 THEN value END) AS v5, max(CASE WHEN ln = 6 THEN value END) AS v6,
  max(CASE WHEN ln = 7 THEN value END) AS v7 FROM fs GROUP BY ALL),
parsed AS (SELECT fixture_id, team,
  CASE WHEN v1 IS NULL THEN NULL WHEN contains(v1, '%') THEN TRY_CAST(replace(v1, '%', '') AS DOUBLE) / 100
       WHEN TRY_CAST(v1 AS DOUBLE) > 1 THEN TRY_CAST(v1 AS DOUBLE) / 100 ELSE TRY_CAST(v1 AS DOUBLE) END AS possession,
  CASE WHEN regexp_matches(v2, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(v2) AS INTEGER) ELSE 0 END AS shots_total,
  CASE WHEN regexp_matches(v3, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(v3) AS INTEGER) ELSE 0 END AS shots_on_target,
  0 AS shots_off_target, 0 AS shots_blocked, 0 AS shots_inside_box, 0 AS shots_outside_box,
  CASE WHEN regexp_matches(v4, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(v4) AS INTEGER) ELSE 0 END AS passes_total,
  0 AS passes_accurate,
  CASE WHEN v5 IS NULL THEN NULL WHEN contains(v5, '%') THEN TRY_CAST(replace(v5, '%', '') AS DOUBLE) / 100
       WHEN TRY_CAST(v5 AS DOUBLE) > 1 THEN TRY_CAST(v5 AS DOUBLE) / 100 ELSE TRY_CAST(v5 AS DOUBLE) END AS pass_accuracy,
  0 AS fouls, CASE WHEN regexp_matches(v6, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(v6) AS INTEGER) ELSE 0 END AS corners,
  0 AS offsides, 0 AS yellow_cards, 0 AS red_cards,
  CASE WHEN regexp_matches(v7, '^\\s*[+-]?\\d+\\s*$') THEN CAST(trim(v7) AS INTEGER) ELSE 0 END AS saves
  FROM wide)
"""
FSTATS = with_views(TEAMS_V) + FIXTURE_STATS

# One row per team: form, fixture statistics (K05), the other provider's over them, sentiment.
PROFILE = with_views(TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V, TEAM_ROWS_V, TEAM_FEATURES_V, TEXTS_V, ADV_V) + FIXTURE_STATS.rstrip() + """,
k5 AS (SELECT team, coalesce(avg(possession), 0) AS possession, avg(shots_on_target) AS shots_on_target,
         CASE WHEN avg(shots_total) = 0 THEN 0 ELSE avg(shots_on_target) / avg(shots_total) END AS shot_accuracy,
         coalesce(avg(pass_accuracy), 0) AS pass_accuracy, avg(corners) AS corners, avg(saves) AS saves FROM parsed GROUP BY team),
""" + SCORED_PAIRS + TEAM_SENTIMENT.rstrip() + """,
pick AS (SELECT t.team, a.*, row_number() OVER (PARTITION BY t.team ORDER BY CASE WHEN a.team = t.team THEN 0 ELSE 1 END, a.team) AS rn
         FROM team_features_v t JOIN adv_v a ON lower(a.team) = lower(t.team)),
mt AS (SELECT t.*, coalesce(p.xg, 0.0) AS xg, coalesce(p.xga, 0.0) AS xga,
    coalesce(p.xg, 0.0) - coalesce(p.xga, 0.0) AS xg_difference, coalesce(p.possession_pct, k5.possession, 0.0) AS avg_possession,
    coalesce(k5.shots_on_target, 0.0) AS avg_shots_on_target, coalesce(k5.shot_accuracy, 0.0) AS shot_accuracy,
    coalesce(k5.pass_accuracy, 0.0) AS avg_pass_accuracy, coalesce(k5.corners, 0.0) AS avg_corners, coalesce(k5.saves, 0.0) AS avg_saves,
    coalesce(p.ppda, 0.0) AS ppda, coalesce(p.progressive_passes, 0.0) AS progressive_passes,
    coalesce(p.progressive_carries, 0.0) AS progressive_carries, coalesce(p.pressures, 0.0) AS pressures,
    s.avg_sentiment, s.post_count, s.positive_ratio, s.negative_ratio
  FROM team_features_v t LEFT JOIN (SELECT * FROM pick WHERE rn = 1) p ON p.team = t.team LEFT JOIN k5 ON k5.team = t.team
  LEFT JOIN sentiment_v s ON s.team = t.team),
prof AS (SELECT team, form_score AS form, avg_goals_scored, avg_goals_conceded, goal_difference AS goal_diff, clean_sheet_rate,
           CAST(comeback_wins AS DOUBLE) AS comeback_wins, avg_sentiment AS sentiment, xg, xga, avg_possession AS possession,
           shot_accuracy, avg_pass_accuracy AS pass_accuracy, avg_shots_on_target AS shots_on_target, ppda FROM mt)
"""

DEFAULTS = {"form": 1.0, "avg_goals_scored": 1.0, "avg_goals_conceded": 1.0, "goal_diff": 0.0,
            "clean_sheet_rate": 0.0, "comeback_wins": 0.0, "sentiment": 0.5, "xg": 0.0, "xga": 0.0,
            "possession": 0.5, "shot_accuracy": 0.0, "pass_accuracy": 0.0, "shots_on_target": 0.0, "ppda": 0.0}


def _feat_sql(name: str) -> str:
    def v(side, a):
        return f"coalesce({side}.{a}, {DEFAULTS[a]})"
    deltas = {"form_delta": "form", "goal_diff_delta": "goal_diff", "sentiment_delta": "sentiment",
              "xg_delta": "xg", "possession_delta": "possession", "shot_accuracy_delta": "shot_accuracy"}
    if name in deltas:
        return f"{v('h', deltas[name])} - {v('a', deltas[name])}"
    side = "h" if name.startswith("home_") else "a"
    attr = name.split("_", 1)[1]
    if attr == "xg_diff":
        return f"{v(side, 'xg')} - {v(side, 'xga')}"
    return v(side, attr)


FROWS = PROFILE + """, fr AS (SELECT m.match_id, m.winner, """ + ", ".join(f"{_feat_sql(n)} AS {n}" for n in FEATURE_NAMES) + """
  FROM matches_w m LEFT JOIN prof h ON h.team = m.home_team LEFT JOIN prof a ON a.team = m.away_team
  WHERE m.status = 'FINISHED')
"""


def _ref_z():
    d = "(h.form - a.form) * 0.8 + (h.goal_diff - a.goal_diff) * 0.3 + (h.sentiment - a.sentiment) * 2.0 + (h.xg - a.xg) * 0.5"
    return f"0.1 + ({d})", "0.2", f"0.0 - ({d})"


_zh, _zd, _za = _ref_z()

LEADERS = f""", pr AS (SELECT h.team, exp({_zh}) / (exp({_zh}) + exp({_zd}) + exp({_za})) AS p
        FROM prof h JOIN prof a ON h.team <> a.team),
      sc AS (SELECT team, avg(p) AS score FROM pr GROUP BY team),
      leaders AS (SELECT team, score, score / (SELECT sum(score) FROM sc) * 100 AS win_pct,
        row_number() OVER (ORDER BY {fx('score', 9)} DESC, team) AS rank FROM sc)
"""


def _scores(home: str, away: str) -> str:
    """Percentages of the closed-form scorer for profile rows ``home`` and ``away``."""
    side = lambda z: z.replace("h.", "\0.").replace("a.", f"{away}.").replace("\0.", f"{home}.")
    h, d, a = side(_zh), _zd, side(_za)
    return ", ".join(f"{fx(f'100 * exp({x}) / (exp({h}) + exp({d}) + exp({a}))', 1)} AS {n}" for x, n in ((h, "home_win"), (d, "draw"), (a, "away_win")))


def _card(side: str) -> str:
    t = side[0]
    zero = ["form_score", "avg_goals_scored", "avg_goals_conceded", "goal_difference", "clean_sheet_rate"]
    return (", ".join(f"{fx(f'coalesce({t}.{c}, 0)')} AS {side}_{c}" for c in zero)
            + f", coalesce({t}.comeback_wins, 0) AS {side}_comeback_wins, {fx(f'coalesce({t}.avg_sentiment, 0.5)')} AS {side}_avg_sentiment, "
            f"{fx(f'coalesce({t}.positive_ratio, 0)')} AS {side}_positive_ratio, coalesce({t}p.players, '') AS {side}_players")


CARDS = PROFILE + ",\n" + PLAYER_EVENTS_V + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY goal_contributions_per_match DESC, player) AS rk FROM player_features_v WHERE team IS NOT NULL),
people AS (SELECT team, string_agg(player || ' ' || goals || ' ' || assists, ', ' ORDER BY rk) AS players FROM ranked WHERE rk <= 3 GROUP BY team),
shown AS (SELECT * FROM matches_w WHERE status IN ('SCHEDULED', 'TIMED') ORDER BY utc_date, match_id LIMIT 10),
full_prof AS (SELECT team, coalesce(form, 1.0) AS form, coalesce(goal_diff, 0.0) AS goal_diff, coalesce(sentiment, 0.5) AS sentiment, coalesce(xg, 0.0) AS xg FROM prof)
SELECT m.match_id, m.utc_date, m.home_team, m.away_team, {_scores('fh', 'fa')}, 'closed_form' AS source, {_card('home')}, {_card('away')}
FROM shown m JOIN full_prof fh ON fh.team = m.home_team JOIN full_prof fa ON fa.team = m.away_team
LEFT JOIN mt h ON h.team = m.home_team LEFT JOIN mt a ON a.team = m.away_team
LEFT JOIN people hp ON hp.team = m.home_team LEFT JOIN people ap ON ap.team = m.away_team"""

ORACLE.update({
    "l01_feature_rows": FROWS + "SELECT match_id, " + ", ".join(f"{fx(n)} AS {n}" for n in FEATURE_NAMES) + " FROM fr",
    "a14_training_csv": FROWS + "SELECT CAST(CASE winner WHEN 'HOME_TEAM' THEN 2 WHEN 'DRAW' THEN 1 ELSE 0 END AS INTEGER) AS label, "
        + ", ".join(f"{fx(n)} AS {n}" for n in FEATURE_NAMES) + " FROM fr WHERE winner IS NOT NULL",
    "l02_labels": M + """x AS (SELECT 1) SELECT CAST(CASE winner WHEN 'HOME_TEAM' THEN 2 WHEN 'DRAW' THEN 1 WHEN 'AWAY_TEAM' THEN 0 END AS INTEGER) AS label,
        count(*) AS matches FROM matches_w WHERE status = 'FINISHED' GROUP BY 1""",
    "l04_scaling": FROWS + " SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {fx(f'avg({n})')} AS mu, {fx(f'stddev_pop({n})')} AS sd FROM fr WHERE winner IS NOT NULL"
        for n in FEATURE_NAMES) + ")",
    "l07_predict_closed_form": PROFILE + f""", s AS (SELECT m.match_id,
        {_zh.replace('h.', 'hp.').replace('a.', 'ap.')} AS zh, {_zd} AS zd, {_za.replace('h.', 'hp.').replace('a.', 'ap.')} AS za
        FROM matches_w m
        LEFT JOIN (SELECT team, coalesce(form, 1.0) AS form, coalesce(goal_diff, 0.0) AS goal_diff, coalesce(sentiment, 0.5) AS sentiment, coalesce(xg, 0.0) AS xg FROM prof) hp ON hp.team = m.home_team
        LEFT JOIN (SELECT team, coalesce(form, 1.0) AS form, coalesce(goal_diff, 0.0) AS goal_diff, coalesce(sentiment, 0.5) AS sentiment, coalesce(xg, 0.0) AS xg FROM prof) ap ON ap.team = m.away_team
        WHERE m.status IN ('SCHEDULED', 'TIMED'))
      SELECT match_id, {fx('100 * exp(zh) / (exp(zh) + exp(zd) + exp(za))', 1)} AS home_win,
        {fx('100 * exp(zd) / (exp(zh) + exp(zd) + exp(za))', 1)} AS draw,
        {fx('100 * exp(za) / (exp(zh) + exp(zd) + exp(za))', 1)} AS away_win, 'closed_form' AS source FROM s""",
    "l09_leaderboard": PROFILE + LEADERS + f"SELECT rank, team, {fx('score')} AS score, {fx('win_pct')} AS win_pct FROM leaders",
    "l11_prediction_card": CARDS,
    "l10_to_show": M + """x AS (SELECT 1) SELECT match_id, utc_date FROM matches_w WHERE status IN ('SCHEDULED', 'TIMED')
        ORDER BY utc_date, match_id LIMIT 10""",
})

# ---- J, K, M ---------------------------------------------------------------------------
ZF = ["avg_goals_scored", "avg_goals_conceded", "goal_difference", "xg", "xga", "xg_difference",
      "avg_possession", "avg_shots_on_target", "avg_pass_accuracy", "progressive_passes",
      "progressive_carries", "pressures"]

MERGED = PROFILE


def _z(c):
    return (f"least(greatest(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
            f"ELSE {c} - avg({c}) OVER () END, -3.0), 3.0)")


PSTATS = with_views(TEAMS_V) + """x AS (SELECT 1),
ps AS (SELECT l.l_orderkey AS fixture_id, l.l_linenumber AS line, 'P' || l.l_suppkey AS name,
  CASE WHEN l.l_suppkey % 2 = 0 THEN t.home ELSE t.away END AS team,
  CASE WHEN l.l_partkey % 23 = 0 THEN NULL ELSE ['G', 'D', 'M', 'F'][l.l_partkey % 4 + 1] END AS position,
  CASE WHEN l.l_orderkey % 19 = 0 THEN NULL ELSE CAST(trunc(l.l_quantity) AS INTEGER) END AS minutes,
  l.l_partkey % 3 AS goals, (l.l_partkey % 5) // 3 AS assists, l.l_partkey % 7 AS shots_total, l.l_partkey % 4 AS shots_on,
  l.l_partkey % 6 AS key_passes, l.l_suppkey % 5 AS dribbles_attempted, l.l_suppkey % 3 AS dribbles_success,
  l.l_partkey % 8 AS tackles, l.l_partkey % 9 AS interceptions, l.l_partkey % 10 AS duels_total, l.l_partkey % 5 AS duels_won,
  l.l_partkey % 4 AS aerial_duels_won, l.l_suppkey % 4 AS fouls_drawn,
  CASE WHEN l.l_partkey % 13 = 0 THEN 1 ELSE 0 END AS yellow_cards, CASE WHEN l.l_partkey % 97 = 0 THEN 1 ELSE 0 END AS red_cards
  FROM lineitem l JOIN teams_v t ON t.o_orderkey = l.l_orderkey),
pa AS (SELECT name, CAST(sum(coalesce(minutes, 0)) AS BIGINT) AS minutes,
  """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in
                  ["goals", "assists", "shots_total", "shots_on", "key_passes", "dribbles_attempted", "dribbles_success",
                   "tackles", "interceptions", "duels_total", "duels_won", "aerial_duels_won", "fouls_drawn",
                   "yellow_cards", "red_cards"]) + """,
  arg_max(team, (fixture_id, line)) FILTER (WHERE team IS NOT NULL AND team <> '') AS team,
  arg_max(position, (fixture_id, line)) FILTER (WHERE position IS NOT NULL AND position <> '') AS position,
  count(*) AS appearances FROM ps GROUP BY name),
p9 AS (SELECT *, CASE WHEN minutes > 0 THEN minutes / 90.0 ELSE 1.0 END AS p90 FROM pa),
padv AS (SELECT name, team, position, minutes, appearances, goals, assists,
  """ + ", ".join(f"{fx(f'{num} / p90', 3)} AS {out}" for num, out in
                  [("goals", "goals_per90"), ("assists", "assists_per90"), ("shots_total", "shots_per90"),
                   ("shots_on", "shots_on_per90"), ("key_passes", "key_passes_per90")]) + f""",
  {fx('CASE WHEN dribbles_attempted = 0 THEN 0 ELSE dribbles_success / dribbles_attempted END', 3)} AS dribble_success_rate,
  {fx('tackles / p90', 3)} AS tackles_per90, {fx('interceptions / p90', 3)} AS interceptions_per90,
  {fx('(tackles + interceptions) / p90', 3)} AS defensive_actions_per90,
  {fx('CASE WHEN duels_total = 0 THEN 0 ELSE duels_won / duels_total END', 3)} AS duel_win_rate,
  aerial_duels_won AS aerial_won, {fx('fouls_drawn / p90', 3)} AS fouls_drawn_per90, yellow_cards, red_cards FROM p9)
"""

PLAYER_TABLE = f"""x AS (SELECT 1) SELECT player, team, goals, assists, yellow_cards, red_cards, matches, goals + assists AS contributions,
    {fx('goals_per_match')} AS goals_per_match, {fx('goal_contributions_per_match')} AS goal_contributions_per_match FROM player_features_v"""

_P2 = lambda c, p=2: fx(f"coalesce({c}, 0)", p)
ADVANCED_PLAYERS = (with_views(TEAMS_V, EVENTS_V, MATCHES_V, ARRAYS_V, PLAYER_EVENTS_V) + PSTATS.split("x AS (SELECT 1),\n")[1].rstrip() + """,
ext AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'X' ELSE 'P' END || s_suppkey AS name, s_suppkey % 50 / 10.0 AS xg, s_suppkey % 30 / 10.0 AS xa,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 40 / 10.0 END AS npxg, s_suppkey % 60 / 10.0 AS key_passes,
    CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 90 / 10.0 END AS progressive_passes, s_suppkey % 70 / 10.0 AS progressive_carries,
    s_suppkey % 200 / 10.0 AS pressures, s_suppkey % 100 AS aerial_won_pct FROM supplier)
""" + "SELECT f.player AS name, f.team, f.goals, f.assists, " + ", ".join([
    *[f"{_P2('ext.' + c)} AS {c}" for c in ("xg", "xa", "npxg")], f"{_P2('coalesce(padv.key_passes_per90, ext.key_passes)')} AS key_passes_per90",
    *[f"{_P2('ext.' + c)} AS {c}" for c in ("progressive_passes", "progressive_carries")],
    *[f"{_P2('ext.' + c, 1)} AS {c}" for c in ("pressures", "aerial_won_pct")],
    f"{_P2('padv.defensive_actions_per90')} AS defensive_actions_per90", f"{_P2('f.goal_contributions_per_match')} AS goal_contributions_per_match"])
    + " FROM (SELECT * FROM player_features_v WHERE team IS NOT NULL AND team <> '') f LEFT JOIN padv ON padv.name = f.player LEFT JOIN ext ON ext.name = f.player")
ADVANCED_PLAYERS = "SELECT * FROM (" + ADVANCED_PLAYERS + ")"

_SNAP = ["avg_goals_scored", "avg_goals_conceded", "goal_difference", "clean_sheet_rate", "comeback_wins", "xg", "xga", "avg_possession",
         "shot_accuracy", "avg_pass_accuracy", "ppda", "positive_ratio", "negative_ratio", "post_count"]
SNAPSHOTS = MERGED + """, both_days AS (SELECT mt.*, 1706659200.0::DOUBLE AS event_time, form_score AS form FROM mt
    UNION ALL SELECT mt.*, 1706572800.0, 0.0 FROM mt)
""" + f"SELECT team AS team_name, event_time, {fx('form')} AS form_score, {fx('coalesce(avg_sentiment, 0.5)')} AS avg_sentiment, " + ", ".join(
    f"{fx(f'coalesce({c}, 0)')} AS {c}" for c in _SNAP) + " FROM both_days"

ORACLE.update({
    "j01_normalize_features": MERGED + "SELECT team, " + ", ".join(f"{fx(_z(c))} AS {c}_z" for c in ZF) + f""",
        {fx('avg_goals_scored')} AS goals_per_match, {fx('avg_goals_conceded')} AS conceded_per_match,
        {fx('xg / greatest(matches_played, 1)')} AS xg_per_match, {fx('xga / greatest(matches_played, 1)')} AS xga_per_match,
        {fx('avg_shots_on_target')} AS shots_per_match FROM mt""",
    "j03_engineer_match_features": MERGED + f""", jm AS (SELECT m.match_id, m.stage, h.team IS NOT NULL AS hk, a.team IS NOT NULL AS ak,
        coalesce(h.xg, 0.0) AS hx, coalesce(a.xg, 0.0) AS ax,
        CASE WHEN h.team IS NULL THEN 1.0 ELSE h.avg_goals_conceded END AS hgc, CASE WHEN a.team IS NULL THEN 1.0 ELSE a.avg_goals_conceded END AS agc,
        CASE WHEN h.team IS NULL THEN 0.0 ELSE h.clean_sheet_rate END AS hcs, CASE WHEN a.team IS NULL THEN 0.0 ELSE a.clean_sheet_rate END AS acs,
        CASE WHEN h.team IS NULL THEN 0.0 ELSE h.avg_saves END AS hsv, CASE WHEN a.team IS NULL THEN 0.0 ELSE a.avg_saves END AS asv,
        CASE WHEN h.team IS NULL THEN 10.0 ELSE h.ppda END AS hpp, CASE WHEN a.team IS NULL THEN 10.0 ELSE a.ppda END AS app,
        CASE WHEN h.team IS NULL THEN 1.0 ELSE h.form_score END AS hf, CASE WHEN a.team IS NULL THEN 1.0 ELSE a.form_score END AS af,
        coalesce(h.avg_sentiment, 0.5) AS hs, coalesce(a.avg_sentiment, 0.5) AS asn
      FROM matches_w m LEFT JOIN mt h ON h.team = m.home_team LEFT JOIN mt a ON a.team = m.away_team
      WHERE m.status IN ('SCHEDULED', 'TIMED')),
      d AS (SELECT *, (1 - hgc / 3) * 0.4 + hcs * 0.4 + hsv / 10 * 0.2 AS hd, (1 - agc / 3) * 0.4 + acs * 0.4 + asv / 10 * 0.2 AS ad,
        1 / greatest(hpp, 0.1) AS hp, 1 / greatest(app, 0.1) AS ap FROM jm)
      SELECT match_id, {fx('hs - asn')} AS sentiment_momentum, {fx('CASE WHEN hx + ax > 0 THEN hx / (hx + ax) ELSE 0.5 END')} AS xg_share,
        {fx('hd')} AS home_defensive_score, {fx('ad')} AS away_defensive_score, {fx('hd - ad')} AS defensive_delta,
        {fx('hp')} AS home_pressing_intensity, {fx('ap')} AS away_pressing_intensity, {fx('hp - ap')} AS pressing_delta,
        CASE WHEN contains(upper(stage), 'ROUND_OF_16') OR contains(upper(stage), 'QUARTER') OR contains(upper(stage), 'SEMI')
          OR contains(upper(stage), 'FINAL') THEN 1.5 ELSE 1.0 END AS stage_weight,
        {fx('hf * hs')} AS form_x_sentiment_home, {fx('af * asn')} AS form_x_sentiment_away FROM d""",
    "k01_fixture_stats": FSTATS + f"SELECT fixture_id, team, {fx('possession')} AS possession, shots_total, shots_on_target, "
        "shots_off_target, shots_blocked, shots_inside_box, shots_outside_box, passes_total, passes_accurate, "
        f"{fx('pass_accuracy')} AS pass_accuracy, fouls, corners, offsides, yellow_cards, red_cards, saves FROM parsed",
    "k05_team_advanced": FSTATS + f"""SELECT team, {fx('coalesce(avg(possession), 0)')} AS avg_possession,
        {fx('avg(shots_total)')} AS avg_shots_total, {fx('avg(shots_on_target)')} AS avg_shots_on_target,
        {fx('avg(shots_inside_box)')} AS avg_shots_inside_box, {fx('avg(passes_total)')} AS avg_passes,
        {fx('coalesce(avg(pass_accuracy), 0)')} AS avg_pass_accuracy, {fx('avg(corners)')} AS avg_corners,
        {fx('avg(fouls)')} AS avg_fouls, {fx('avg(saves)')} AS avg_saves, count(*) AS matches_sampled,
        {fx('CASE WHEN avg(shots_total) = 0 THEN 0 ELSE avg(shots_on_target) / avg(shots_total) END')} AS shot_accuracy
        FROM parsed GROUP BY team""",
    "k06_player_advanced": PSTATS + "SELECT * FROM padv",
    "m06_scoring_depth": PLAY + """x AS (SELECT 1) SELECT team, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists
        FROM player_features_v GROUP BY team""",
    "m07_team_list": M + "x AS (SELECT 1) SELECT home_team AS team FROM matches_w UNION SELECT away_team FROM matches_w UNION SELECT 'All'",
    "m08_advanced_team_table": MERGED + "SELECT team, " + ", ".join(f"{fx(f'{c} * {f}', p)} AS {c}" for c, f, p in [
        ("xg", 1, 2), ("xga", 1, 2), ("xg_difference", 1, 2), ("avg_possession", 100, 1), ("shot_accuracy", 100, 1), ("avg_pass_accuracy", 100, 1),
        ("avg_shots_on_target", 1, 1), ("avg_corners", 1, 1), ("ppda", 1, 2), ("progressive_passes", 1, 1), ("progressive_carries", 1, 1),
        ("pressures", 1, 1)]) + " FROM mt",
    "m09_data_present": MERGED + "SELECT sum(xg) > 0 AS has_advanced FROM mt",
    "m10_ppda_ranking": MERGED + f"SELECT team, {fx('ppda')} AS ppda FROM mt WHERE ppda > 0",
    "m04_player_table": PLAY + PLAYER_TABLE,
    "m04_team_players": PLAY + PLAYER_TABLE + " WHERE team = 'TEAM_3' AND matches >= 3",
    "m01_kpis": PROFILE + ",\n" + PLAYER_EVENTS_V + f"""SELECT (SELECT count(*) FROM matches_w WHERE status = 'FINISHED') AS matches_played,
        (SELECT count(*) FROM matches_w WHERE status IN ('SCHEDULED', 'TIMED')) AS upcoming, (SELECT count(*) FROM mt) AS teams,
        (SELECT count(*) FROM player_features_v) AS players, (SELECT sum(post_count)::BIGINT FROM sentiment_v) AS posts,
        (SELECT {fx('avg(avg_sentiment)')} FROM sentiment_v) AS mean_sentiment""",
    "m02_leaderboard_table": PROFILE + LEADERS + f"""SELECT l.rank, l.team, {fx('l.score')} AS score, {fx('l.win_pct')} AS win_pct, {fx('form_score')} AS form_score,
        {fx('goal_difference')} AS goal_difference, {fx('total_points')} AS total_points, matches_played,
        {fx('coalesce(avg_sentiment, 0.5)', 3)} AS avg_sentiment FROM leaders l JOIN mt USING (team)""",
    "m03_team_sentiment_table": TP + TEAM_SENTIMENT + f"""SELECT team, {fx('avg_sentiment * 100')} AS sentiment_pct, post_count,
        {fx('positive_ratio * 100')} AS positive_pct, {fx('negative_ratio * 100')} AS negative_pct FROM sentiment_v""",
    "m11_advanced_player_merge": ADVANCED_PLAYERS,
    "m11_team_players": ADVANCED_PLAYERS + " WHERE team = 'TEAM_3'",
    "a15_feature_snapshot": SNAPSHOTS,
    "a16_latest_snapshot": SNAPSHOTS.replace("FROM both_days", "FROM both_days WHERE event_time = 1706659200.0"),
    "a07_full_sync": M + """x AS (SELECT 1), c AS (SELECT match_id, count(*) FILTER (WHERE is_goal) AS g, count(*) FILTER (WHERE kind = 'card') AS c,
        count(*) FILTER (WHERE kind = 'sub') AS s FROM events_v WHERE status = 'FINISHED' GROUP BY match_id)
      SELECT m.match_id, m.status, coalesce(g, 0)::INTEGER AS n_goals, coalesce(c, 0)::INTEGER AS n_cards, coalesce(s, 0)::INTEGER AS n_subs
      FROM matches_w m LEFT JOIN c USING (match_id)""",
    "a12_fixture_events": with_views(TEAMS_V, EVENTS_V) + """x AS (SELECT 1) SELECT match_id AS fixture_id,
        CAST(row_number() OVER (PARTITION BY match_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos, team, player, minute,
        CASE kind WHEN 'goal' THEN 'Goal' WHEN 'card' THEN 'Card' ELSE 'subst' END AS type,
        CASE WHEN is_goal THEN 'Normal Goal' WHEN kind = 'goal' THEN 'Missed Penalty' WHEN kind = 'card' THEN card ELSE 'Substitution 1' END AS detail
      FROM events_v WHERE status = 'LIVE'""",
    "m05_top20": PLAY + f"""x AS (SELECT 1) SELECT player, team, goals, assists, {fx('goal_contributions_per_match')} AS goal_contributions_per_match,
        yellow_cards, red_cards FROM player_features_v ORDER BY goal_contributions_per_match DESC, player LIMIT 20""",
})


# ---- provider payloads, search and polls; A16 as of a time; D17 by vote --------------------
from fansignal.plans import ingest  # noqa: E402

ORACLE.update(ingest.ORACLE)

ORACLE["a16_as_of"] = FEAT[:-2] + """,
days AS (SELECT team, CAST(utc_date AS DATE) AS day, count(*) AS m, sum(points) AS p, sum(gf) AS f, sum(ga) AS a FROM team_rows_v GROUP BY ALL),
hist AS (SELECT team, CAST(day + 1 AS TIMESTAMP) AS valid_from, sum(m) OVER w AS m, sum(p) OVER w AS p, sum(f) OVER w AS f, sum(a) OVER w AS a
         FROM days WINDOW w AS (PARTITION BY team ORDER BY day)),
req AS (SELECT match_id, utc_date, 'home' AS side, home_team AS team FROM matches_w UNION ALL SELECT match_id, utc_date, 'away', away_team FROM matches_w)
SELECT r.match_id, r.utc_date, r.side, r.team, h.valid_from, h.m::BIGINT AS matches_before, h.p::BIGINT AS points_before,
  h.f::BIGINT AS goals_before, h.a::BIGINT AS conceded_before
FROM req r ASOF LEFT JOIN hist h ON h.team = r.team AND r.utc_date >= h.valid_from"""

# The word lists are the operator's parameter; the vote is stated anew.
from fansignal.functions.language import FUNCTION_WORDS  # noqa: E402

_WORDS = ", ".join(f"('{lang}', '{w}')" for lang, ws in FUNCTION_WORDS.items() for w in ws.split())
ORACLE["d17_vote"] = f"""
WITH given(lang, word) AS (VALUES {_WORDS}),
forms AS (SELECT lang, word FROM given UNION SELECT lang, strip_accents(word) FROM given),
share AS (SELECT lang, word, 1.0 / count(*) OVER (PARTITION BY word) AS vote FROM forms),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) AS word FROM documents),
votes AS (SELECT doc_id, share.lang, sum(vote) AS v FROM tok JOIN share USING (word) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, lang DESC) AS rn,
             coalesce(lead(v) OVER (PARTITION BY doc_id ORDER BY v DESC, lang DESC), 0) AS second FROM votes)
SELECT d.doc_id, d.lang, CASE WHEN r.v - r.second >= 1.0 THEN r.lang ELSE 'unknown' END AS detected
FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND r.rn = 1"""
