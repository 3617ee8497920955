"""The fixture views of ``fansignal.sources.fixtures`` written as plain SQL (DuckDB dialect),
from the FIXTURES.md definitions. Oracle queries prepend the CTEs they need."""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

POSTS_V = """posts_v AS (
  SELECT event_id AS post_id, ts AS "timestamp", user_id,
    CASE user_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'twitter' ELSE 'youtube' END AS source,
    CASE WHEN user_id % 25 = 0 THEN 'newsbot_' || user_id ELSE 'user_' || user_id END AS author,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
         WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    least(value / 100.0, 1.0) AS sentiment_score,
    CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) AS like_count,
    CAST(event_id % 40 - 15 AS INTEGER) AS score
  FROM events)"""

POST_ENTITIES_V = """post_entities_v AS (
  SELECT post_id, "timestamp", 'TEAM_' || (user_id % 25) AS name FROM posts_v
  UNION ALL
  SELECT post_id, "timestamp", 'PLAYER_' || user_id AS name FROM posts_v)"""

TEXTS_V = """texts_v AS (
  SELECT doc_id, lang, source,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts,
    'user_' || (doc_id % 150) AS author,
    CASE doc_id % 8
      WHEN 0 THEN 'What a golazo #WorldCup2026 https://ex.am/p?q=1 ' || text
      WHEN 1 THEN '@ref_1 robbed by VAR &amp; a howler ' || text
      WHEN 2 THEN 'www.ex.am/x bottled it, pure class from the gaffer  ' || text
      WHEN 3 THEN 'GOAAAAAAAAAAL ' || text
      WHEN 4 THEN 'TEAM_' || (doc_id % 25) || ' v TEAM_' || ((doc_id + 3) % 25) || ': pens after AET '
             || CASE doc_id // 8 % 5 WHEN 0 THEN 'great win ' WHEN 1 THEN 'terrible ' WHEN 2 THEN 'great great terrible ' ELSE '' END || text
      WHEN 5 THEN '#fifa world cup #other ' || text
      WHEN 6 THEN '12345 67890 !!! ' || text
      ELSE text END AS text
  FROM documents
  UNION ALL
  SELECT doc_id + 1000000000000, lang, source, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id),
    'user_' || (doc_id % 150), 'GOAAAAAAAAAAL ' FROM documents WHERE doc_id % 8 = 3)"""

TEAMS_V = """teams_v AS (
  SELECT o.o_orderkey,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((o.o_orderkey * 37) % 43200 AS BIGINT)) AS utc_date,
    o.o_orderstatus, o.o_orderpriority,
    CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'FINAL' WHEN '2' THEN 'QUARTER_FINALS'
      WHEN '3' THEN 'ROUND_OF_16' WHEN '4' THEN 'Round of 16' WHEN '5' THEN 'Group Stage - 1' END AS stage,
    CASE o.o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'SCHEDULED' WHEN 'P' THEN 'LIVE' END AS status,
    'TEAM_' || c.c_nationkey AS home,
    'TEAM_' || ((c.c_nationkey + 1 + o.o_orderkey % 24) % 25) AS away
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

# One row per raw event line, typed, with the team it belongs to.
EVENTS_V = """events_v AS (
  SELECT l.l_orderkey AS match_id, t.utc_date, t.status, t.home, t.away,
    l.l_linenumber, l.l_partkey, l.l_suppkey,
    CAST(1 + l.l_partkey % 90 AS INTEGER) AS minute,
    CASE WHEN l.l_suppkey % 2 = 0 THEN t.home ELSE t.away END AS team,
    CASE WHEN l.l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side,
    'P' || l.l_suppkey AS player,
    CASE l.l_returnflag WHEN 'R' THEN 'goal' WHEN 'A' THEN 'card' ELSE 'sub' END AS kind,
    (l.l_returnflag = 'R' AND l.l_partkey % 11 <> 0) AS is_goal,
    CASE WHEN l.l_returnflag = 'R' AND l.l_partkey % 3 <> 0 THEN 'P' || (l.l_suppkey + 1) END AS goal_assist,
    CASE WHEN l.l_returnflag = 'A' THEN
      CASE WHEN l.l_partkey % 13 = 0 THEN 'Second Yellow card'
           WHEN l.l_linestatus = 'F' THEN 'Yellow Card' ELSE 'Red Card' END END AS card
  FROM lineitem l JOIN teams_v t ON l.l_orderkey = t.o_orderkey)"""

# Matches with scores (NULL when not started) and winner.
MATCHES_V = """matches_v AS (
  SELECT t.o_orderkey AS match_id, t.status, t.stage, t.utc_date, t.home AS home_team, t.away AS away_team,
    CASE WHEN t.status <> 'SCHEDULED' THEN CAST(coalesce(s.hf, 0) AS INTEGER) END AS home_score_ft,
    CASE WHEN t.status <> 'SCHEDULED' THEN CAST(coalesce(s.af, 0) AS INTEGER) END AS away_score_ft,
    CASE WHEN t.status <> 'SCHEDULED' THEN CAST(coalesce(s.hh, 0) AS INTEGER) END AS home_score_ht,
    CASE WHEN t.status <> 'SCHEDULED' THEN CAST(coalesce(s.ah, 0) AS INTEGER) END AS away_score_ht
  FROM teams_v t LEFT JOIN (
    SELECT match_id,
      count(*) FILTER (WHERE is_goal AND side = 'home') AS hf,
      count(*) FILTER (WHERE is_goal AND side = 'away') AS af,
      count(*) FILTER (WHERE is_goal AND side = 'home' AND minute <= 45) AS hh,
      count(*) FILTER (WHERE is_goal AND side = 'away' AND minute <= 45) AS ah
    FROM events_v GROUP BY match_id) s ON s.match_id = t.o_orderkey),
matches_w AS (
  SELECT *, CASE WHEN coalesce(home_score_ft, 0) > coalesce(away_score_ft, 0) THEN 'HOME_TEAM'
                 WHEN coalesce(away_score_ft, 0) > coalesce(home_score_ft, 0) THEN 'AWAY_TEAM'
                 WHEN home_score_ft IS NOT NULL THEN 'DRAW' END AS winner
  FROM matches_v)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + ",\n"


def fx(expr: str, places: int = 6) -> str:
    """Order-independent rounding (same rule as ``functions.common.fixed6``)."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {places}) AS DOUBLE)"

# Events attached to finished and live matches, with their position inside each array.
ARRAYS_V = """goals_v AS (
  SELECT match_id, status, utc_date, home, away, minute, team, player AS scorer, goal_assist AS assist,
    'Normal Goal' AS type,
    row_number() OVER (PARTITION BY match_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
  FROM events_v WHERE is_goal AND status IN ('FINISHED', 'LIVE')),
cards_v AS (
  SELECT match_id, status, utc_date, home, away, minute, team, player, card,
    row_number() OVER (PARTITION BY match_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
  FROM events_v WHERE kind = 'card' AND status IN ('FINISHED', 'LIVE')),
subs_v AS (
  SELECT match_id, minute, team, player AS player_out, 'P' || (l_suppkey + 1) AS player_in,
    row_number() OVER (PARTITION BY match_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos
  FROM events_v WHERE kind = 'sub' AND status IN ('FINISHED', 'LIVE'))"""

# Home/away rows of finished matches.
TEAM_ROWS_V = """team_rows_v AS (
  SELECT m.match_id, m.utc_date, m.stage, s.team, s.side, s.gf, s.ga, s.ht_for, s.ht_against,
    CASE WHEN (s.side = 'home' AND m.winner = 'HOME_TEAM') OR (s.side = 'away' AND m.winner = 'AWAY_TEAM') THEN 3
         WHEN m.winner = 'DRAW' THEN 1 ELSE 0 END AS points,
    (SELECT count(*) FROM cards_v c WHERE c.match_id = m.match_id AND c.team = s.team) AS cards,
    (SELECT count(*) FROM goals_v g WHERE g.match_id = m.match_id AND g.team = s.team) AS event_goals
  FROM matches_w m, LATERAL (
    SELECT m.home_team AS team, 'home' AS side, coalesce(m.home_score_ft, 0) AS gf, coalesce(m.away_score_ft, 0) AS ga,
           coalesce(m.home_score_ht, 0) AS ht_for, coalesce(m.away_score_ht, 0) AS ht_against
    UNION ALL
    SELECT m.away_team, 'away', coalesce(m.away_score_ft, 0), coalesce(m.home_score_ft, 0),
           coalesce(m.away_score_ht, 0), coalesce(m.home_score_ht, 0)) s
  WHERE m.status = 'FINISHED'),
team_rows_w AS (
  SELECT *, pow(0.8, row_number() OVER (PARTITION BY team ORDER BY utc_date DESC, match_id DESC) - 1) AS weight
  FROM team_rows_v)"""

TEAM_FEATURES_V = """team_features_v AS (
  SELECT team, count(*) AS matches_played,
    CASE WHEN sum(weight) = 0 THEN 0 ELSE sum(points * weight) / sum(weight) END AS form_score,
    CASE WHEN sum(weight) = 0 THEN 0 ELSE sum(gf * weight) / sum(weight) END AS avg_goals_scored,
    CASE WHEN sum(weight) = 0 THEN 0 ELSE sum(ga * weight) / sum(weight) END AS avg_goals_conceded,
    sum(gf * weight) - sum(ga * weight) AS goal_difference,
    avg(CASE WHEN ga = 0 THEN 1.0 ELSE 0.0 END) AS clean_sheet_rate,
    count(*) FILTER (WHERE ht_for < ht_against AND gf > ga) AS comeback_wins,
    avg(cards) AS avg_cards, avg(event_goals) AS avg_event_goals,
    CAST(sum(points) AS DOUBLE) AS total_points
  FROM team_rows_w GROUP BY team)"""

PLAYER_EVENTS_V = """player_events_v AS (
  SELECT match_id, utc_date, scorer AS player, team, 'goal' AS kind, 0 AS kind_rank, pos, 0 AS role
    FROM goals_v WHERE status = 'FINISHED'
  UNION ALL
  SELECT match_id, utc_date, assist, team, 'assist', 0, pos, 1 FROM goals_v WHERE status = 'FINISHED' AND assist IS NOT NULL
  UNION ALL
  SELECT match_id, utc_date, player, team,
    CASE WHEN upper(card) LIKE '%YELLOW%' THEN 'yellow' WHEN upper(card) LIKE '%RED%' THEN 'red' ELSE 'card' END,
    1, pos, 0 FROM cards_v WHERE status = 'FINISHED'),
player_features_v AS (
  SELECT a.player, t.team, a.goals, a.assists, a.yellow_cards, a.red_cards, a.matches,
    CASE WHEN a.matches = 0 THEN 0 ELSE a.goals / a.matches END AS goals_per_match,
    CASE WHEN a.matches = 0 THEN 0 ELSE (a.goals + a.assists) / a.matches END AS goal_contributions_per_match
  FROM (SELECT player, count(*) FILTER (WHERE kind = 'goal') AS goals, count(*) FILTER (WHERE kind = 'assist') AS assists,
          count(*) FILTER (WHERE kind = 'yellow') AS yellow_cards, count(*) FILTER (WHERE kind = 'red') AS red_cards,
          count(DISTINCT match_id) AS matches
        FROM player_events_v GROUP BY player) a
  JOIN (SELECT player, team FROM (SELECT player, team, row_number() OVER (PARTITION BY player
          ORDER BY utc_date DESC, match_id DESC, kind_rank DESC, pos DESC, role DESC) AS rn FROM player_events_v) WHERE rn = 1) t
  ON t.player = a.player)"""

ADV_V = """adv_v AS (
  SELECT CASE WHEN n_nationkey % 2 = 1 THEN lower('TEAM_' || n_nationkey) ELSE 'TEAM_' || n_nationkey END AS team,
    CAST(n_nationkey / 10.0 AS DOUBLE) AS xg, CAST((24 - n_nationkey) / 10.0 AS DOUBLE) AS xga,
    CAST((40 + n_nationkey) / 100.0 AS DOUBLE) AS possession_pct,
    CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE 5.0 + n_nationkey % 7 END AS DOUBLE) AS ppda,
    CAST(100.0 + 3 * n_nationkey AS DOUBLE) AS progressive_passes,
    CAST(80.0 + 2 * n_nationkey AS DOUBLE) AS progressive_carries,
    CAST(150.0 + n_nationkey AS DOUBLE) AS pressures
  FROM nation
  UNION ALL SELECT 'TEAM_99', 9.9, 0.1, 0.9, 1.0, 1.0, 1.0, 1.0)"""
