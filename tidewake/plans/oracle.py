"""SQL of the analytical queries, written on its own from the semantics."""

from __future__ import annotations

from tidewake.operators.ml import FEATURES, PLAIN
from tidewake.plans.analysis import MIN_SHARED

# One round of label propagation per step: the accounts of one half look around, then the others.
_HALF = """v{i} AS (SELECT e.n, c.label AS vote, sum(w) AS w FROM {edges} e JOIN {from_} c ON c.n = e.m WHERE {when} GROUP BY 1, 2),
      t{i} AS (SELECT v.n, arg_min(vote, struct_pack(w := -w, other := vote <> c.label, vote := vote)) AS vote FROM v{i} v JOIN {from_} c ON c.n = v.n GROUP BY 1),
      l{i} AS (SELECT c.p, c.n, coalesce(t.vote, c.label) AS label, c.moved OR t.vote IS NOT NULL AND t.vote <> c.label AS moved FROM {from_} c LEFT JOIN t{i} t USING (n))"""
_EARLY = "md5(e.n || ':42:' || c.p) < '8'"
_SPREAD = """{out}(p, n, label, moved) AS (SELECT 0, n, n, true FROM (SELECT DISTINCT n FROM {edges})
    UNION ALL SELECT p + 1, n, label, moved FROM (
      WITH now AS (SELECT p, n, label, false AS moved FROM {out} WHERE p < 40 AND (SELECT bool_or(moved) FROM {out})),
      {first},
      {second}
      SELECT * FROM l2))"""


def _spread(out: str, edges: str) -> str:
    first = _HALF.format(i=1, edges=edges, from_="now", when=_EARLY)
    return _SPREAD.format(out=out, edges=edges, first=first, second=_HALF.format(i=2, edges=edges, from_="l1", when=f"NOT {_EARLY}"))


_GROUPS = f"""tight AS (SELECT account_a AS a, account_b AS c, 4 * shared_within_15m + 2 * shared_within_60m + shared_retweets AS w, shared_retweets AS s, shared_within_15m + shared_within_60m AS k FROM pairs),
    enough AS (SELECT count(*) > 0 AS y FROM tight WHERE k >= 2),
    te AS (SELECT a, c, w FROM tight, enough WHERE CASE WHEN y THEN k >= 2 ELSE s >= 3 AND k >= 1 END),
    tb AS (SELECT a AS n, c AS m, w FROM te WHERE w > 0 UNION ALL SELECT c, a, w FROM te WHERE w > 0 AND a <> c),
    {_spread("lp", "tb")},
    label1 AS (SELECT n, label FROM lp WHERE p = (SELECT max(p) FROM lp)),
    large AS (SELECT label FROM label1 GROUP BY 1 HAVING count(*) > 18),
    ce AS (SELECT account_a AS a, account_b AS c, 4 * shared_within_15m + 2 * shared_within_60m AS w FROM pairs JOIN label1 x ON x.n = account_a JOIN label1 y ON y.n = account_b
      WHERE x.label = y.label AND x.label IN (SELECT label FROM large) AND (shared_within_15m >= 2 OR shared_within_60m >= 3)),
    cb AS (SELECT a AS n, c AS m, w FROM ce WHERE w > 0 UNION ALL SELECT c, a, w FROM ce WHERE w > 0 AND a <> c),
    {_spread("lq", "cb")},
    label2 AS (SELECT n, label AS part, count(*) OVER (PARTITION BY label) AS size FROM lq WHERE p = (SELECT max(p) FROM lq)),
    grp AS (SELECT n, CASE WHEN size > 1 THEN '1:' || part ELSE '0:' || label END AS community FROM label1 LEFT JOIN label2 USING (n))"""

_CTES = {
    "cm": """cm AS (SELECT * FROM members WHERE snapshot_id = (SELECT max(snapshot_id) FROM members) AND screen_name IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY screen_name ORDER BY loaded_at DESC NULLS LAST, member_id DESC) = 1)""",
    "b": """b AS (SELECT *, content_tweet_id AS o, row_number() OVER (PARTITION BY content_tweet_id ORDER BY posted_at NULLS LAST, author_handle, row_id) AS rn,
      min(posted_at) OVER (PARTITION BY content_tweet_id) AS t0 FROM tweets WHERE is_retweet)""",
    "casc": """casc AS (SELECT o AS original_tweet_id, max(content_author_handle) FILTER (rn = 1) AS original_author_handle, max(content_created_at) FILTER (rn = 1) AS original_created_at,
      count(*) AS retweet_count, count(DISTINCT author_handle) AS unique_retweeter_count, max(author_handle) FILTER (rn = 1) AS first_retweeter, min(posted_at) AS first_retweet_at,
      CASE WHEN count(posted_at) = count(*) THEN max(posted_at) END AS last_retweet_at,
      count(*) FILTER (epoch_us(posted_at) - epoch_us(t0) <= 900000000) AS retweets_within_15m, count(*) FILTER (epoch_us(posted_at) - epoch_us(t0) <= 3600000000) AS retweets_within_60m
      FROM b GROUP BY o)""",
    "acc": """firsts AS (SELECT first_retweeter AS h, count(*) AS n FROM casc GROUP BY 1),
    src AS (SELECT author_handle AS h, content_author_handle AS s, count(*) AS n, min(row_id) AS seen FROM tweets WHERE is_retweet GROUP BY 1, 2),
    tops AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY h ORDER BY n DESC, seen) = 1),
    srcs AS (SELECT h, count(*) AS authors, sum(CASE WHEN s IN (SELECT screen_name FROM cm) THEN n ELSE 0 END)::BIGINT AS to_members FROM src GROUP BY 1),
    base AS (SELECT author_handle AS h, count(*) AS tweet_count, count(*) FILTER (is_retweet) AS retweet_count, count(*) FILTER (is_quote) AS quote_count,
      count(DISTINCT content_tweet_id) FILTER (is_retweet) AS posts, sum(coalesce(len(hashtags), 0))::BIGINT AS hashtag_count, sum(coalesce(len(mentions), 0))::BIGINT AS mention_count
      FROM tweets GROUP BY 1),
    acc0 AS (SELECT base.h AS account_handle, cm.screen_name IS NOT NULL AS in_member_list, tweet_count, retweet_count, tweet_count - retweet_count AS original_count, quote_count,
      round(retweet_count / tweet_count, 4) AS retweet_ratio, coalesce(firsts.n, 0) AS first_retweeter_count, posts AS unique_retweeted_tweet_count,
      coalesce(authors, 0) AS unique_retweeted_author_count, coalesce(to_members, 0) AS retweets_to_member_count,
      CASE WHEN retweet_count = 0 THEN 0.0 ELSE round(to_members / retweet_count, 4) END AS retweets_to_member_ratio, tops.s AS top_amplified_account,
      coalesce(tops.n, 0) AS top_amplified_count, CASE WHEN retweet_count = 0 THEN 0.0 ELSE round(tops.n / retweet_count, 4) END AS top_amplified_share,
      hashtag_count, mention_count, followers_count, friends_count, statuses_count, cm.created_at AS account_created_at, default_profile, default_profile_image, is_blue_verified,
      profile_description_language
      FROM base LEFT JOIN srcs USING (h) LEFT JOIN tops USING (h) LEFT JOIN firsts USING (h) LEFT JOIN cm ON cm.screen_name = base.h),
    acc AS (SELECT *, {score} AS coordination_score FROM acc0)""",
    "pairs": """able AS (SELECT author_handle AS h, count(DISTINCT content_tweet_id) AS n FROM tweets WHERE is_retweet GROUP BY 1),
    raw AS (SELECT least(x.author_handle, y.author_handle) AS a, greatest(x.author_handle, y.author_handle) AS c, x.o, abs(epoch_us(x.posted_at) - epoch_us(y.posted_at)) AS lag
      FROM b x JOIN b y ON x.o = y.o AND x.rn < y.rn),
    pairs AS (SELECT a AS account_a, c AS account_b, shared AS shared_retweets, round(shared / CASE WHEN a = c THEN p.n ELSE p.n + q.n - shared END, 4) AS jaccard, w15 AS shared_within_15m,
      w60 AS shared_within_60m FROM (SELECT a, c, count(DISTINCT o) AS shared, count(*) FILTER (lag <= 900000000) AS w15, count(*) FILTER (lag <= 3600000000) AS w60
      FROM raw GROUP BY 1, 2 HAVING count(DISTINCT o) >= {min}) JOIN able p ON p.h = a JOIN able q ON q.h = c)""",
    "net": """e AS (SELECT account_a AS x, account_b AS y FROM pairs WHERE account_a <> account_b UNION SELECT account_b, account_a FROM pairs WHERE account_a <> account_b),
    nn AS (SELECT account_a AS v FROM pairs UNION SELECT account_b FROM pairs),
    reach(v, g) USING KEY (v) AS (SELECT v, v FROM nn UNION SELECT e.y, min(r.g) FROM reach r JOIN e ON e.x = r.v JOIN recurring.reach AS o ON o.v = e.y WHERE r.g < o.g GROUP BY e.y),
    ids AS (SELECT g, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, g) AS id FROM reach GROUP BY g),
    sides AS (SELECT account_a AS v, account_b AS w, * FROM pairs UNION ALL SELECT account_b, account_a, * FROM pairs),
    nodes AS (SELECT v AS account_handle, id AS component_id, any_value(size) AS component_size, count(DISTINCT w) AS neighbor_count, sum(shared_retweets)::BIGINT AS weighted_degree,
      sum(shared_within_15m)::BIGINT AS within_15m_weight, sum(shared_within_60m)::BIGINT AS within_60m_weight, max(struct_pack(s := shared_retweets, w := w)).w AS strongest_neighbor,
      max(shared_retweets) AS max_shared_edge FROM sides JOIN reach USING (v) JOIN ids USING (g) GROUP BY v, id)""",
    "roles": """hasc AS (SELECT account_handle, list(cohort_id ORDER BY cohort_id) AS cids FROM incoh GROUP BY 1),
    said AS (SELECT acc.*, hasc.cids, cm.description AS d, cm.listed_count, cm.screen_name IS NOT NULL AS known,
      CASE WHEN acc.friends_count > 0 THEN acc.followers_count / acc.friends_count WHEN acc.friends_count <= 0 AND acc.followers_count > 0 THEN 'infinity'::DOUBLE END AS ff,
      {media} AS media, {business} AS business, {journalist} AS journalist, {public_figure} AS public_figure FROM acc LEFT JOIN cm ON cm.screen_name = acc.account_handle LEFT JOIN hasc ON hasc.account_handle = acc.account_handle),
    roles AS (SELECT *, CASE WHEN tweet_count >= 3 AND retweet_ratio <= 0.3 AND original_count >= 3 THEN 'source_hub'
      WHEN media OR business OR coalesce(listed_count >= 50, false) OR coalesce(followers_count >= 10000 AND ff >= 25, false) THEN 'media_business'
      WHEN (journalist OR public_figure) AND (coalesce(is_blue_verified, false) OR coalesce(followers_count >= 5000, false) OR coalesce(ff >= 3, false)) THEN 'journalist_public_figure'
      WHEN tweet_count >= 5 AND retweet_ratio >= 0.85 AND original_count <= 1 AND (cids IS NOT NULL OR top_amplified_share >= 0.5 OR first_retweeter_count >= 3) THEN 'amplifier_suspect'
      WHEN known AND coalesce(followers_count < 5000, false) AND NOT coalesce(listed_count >= 10, false) AND NOT (retweet_ratio >= 0.9 AND original_count = 0) THEN 'retail_user'
      WHEN tweet_count >= 3 THEN 'mixed_behavior' ELSE 'unknown' END AS role_label FROM said)""",
    "groups": _GROUPS,
    "coh": """present AS (SELECT community, o, count(*) AS here FROM (SELECT DISTINCT o, author_handle AS n FROM b) JOIN grp USING (n) GROUP BY 1, 2),
    gsize AS (SELECT community, count(*) AS m, list(n ORDER BY n) AS members FROM grp GROUP BY 1 HAVING count(*) >= 3),
    picked AS (SELECT community, o, here, m, members, original_author_handle AS t, floor(greatest(trunc((epoch_us(last_retweet_at) - epoch_us(first_retweet_at)) / 1000000), 0) / greatest(retweet_count - 1, 1)) AS tight
      FROM present JOIN gsize USING (community) JOIN casc ON original_tweet_id = o WHERE here >= greatest(2, least(ceil(ln(greatest(m, 2)) + 1), ceil(m * 0.3), 4))),
    aim AS (SELECT community, t, count(*) AS n FROM picked GROUP BY 1, 2),
    aims AS (SELECT community, count(*) AS targets, sum(n * n) / (sum(n) * sum(n)) AS hhi, max(n) AS tn, arg_min(t, struct_pack(n := -n, t := t)) AS tt FROM aim GROUP BY 1),
    timed AS (SELECT community, any_value(m) AS m, any_value(members) AS members, count(*) AS cascades, floor(median(tight))::BIGINT AS tight, max(here) AS most,
      arg_min(o, struct_pack(h := -here, o := o)) AS top FROM picked GROUP BY 1 HAVING count(*) >= 2),
    home AS (SELECT community, list(DISTINCT component_id ORDER BY component_id) AS parts FROM grp JOIN nodes ON account_handle = n GROUP BY 1),
    scored AS (SELECT *, round(4 * ln(1 + m) + 6 * ln(1 + cascades) + 25 * hhi + coalesce(greatest(0, 20 - least(tight, 3600) / 180), 0), 4) AS cohort_score FROM timed JOIN aims USING (community)),
    coh AS (SELECT *, row_number() OVER (ORDER BY cohort_score DESC, m DESC, cascades DESC, members[1]) AS cohort_id FROM scored LEFT JOIN home USING (community)),
    incoh AS (SELECT cohort_id, unnest(members) AS account_handle FROM coh),
    byc AS (SELECT o, list(cohort_id ORDER BY cohort_id) AS ids FROM (SELECT o, cohort_id, count(*) AS n FROM (SELECT DISTINCT o, author_handle AS account_handle FROM b) JOIN incoh USING (account_handle) GROUP BY 1, 2)
      JOIN (SELECT cohort_id, m FROM coh) USING (cohort_id) WHERE n >= greatest(2, floor(m * 0.2)) GROUP BY 1)""",
    "steps": """steps AS (SELECT o AS original_tweet_id, rn, author_handle AS account_handle, source_client,
      coalesce(trunc((epoch_us(posted_at) - epoch_us(t0)) / 1000000)::BIGINT, 0) AS elapsed FROM b)""",
}
_SCORE = """round(least(retweet_ratio::DECIMAL(10,4), 1) * 35 + CASE WHEN tweet_count >= 5 AND original_count = 0 THEN 15 ELSE 0 END
  + least(first_retweeter_count, 20)::DECIMAL(10,0) * 1.25 + top_amplified_share::DECIMAL(10,4) * 10 + retweets_to_member_ratio::DECIMAL(10,4) * 15, 2)::DOUBLE"""


#: The words again, as the semantics state them, so that a wrong list shows.
_WORDS = {
    "media": "news|media|press|tv|radio|newspaper|magazine|journal|official|channel|broadcast|bulletin|newsroom|agency|gazette|publisher|times|herald|tribune|daily|report|reporter|reporters|εφημερίδα|τηλεόραση|κανάλι|ειδήσεις",
    "business": r"Ltd|LLC|Inc|GmbH|S\.A|BV|Company|Corp|AE|EPE|IKE",
    "journalist": "journalist|reporter|editor|correspondent|anchor|columnist|writer|author|δημοσιογράφος|συντάκτης|αρθρογράφος",
    "public_figure": "MP|minister|politician|mayor|president|senator|CEO|founder|professor|βουλευτής|υπουργός|δήμαρχος|πρόεδρος|καθηγητής",
}
_BEGINNINGS = {"media": "|δημοσιογρ"}


def _word(kind: str) -> str:
    """Greek letters are word characters for Spark; here they are told off by hand."""
    other = r"[^\p{L}\p{N}_]"
    return f"regexp_matches(coalesce(cm.description, ''), '(?:^|{other})(?:(?:{_WORDS[kind]})(?:{other}|$){_BEGINNINGS.get(kind, '')})', 'i')"


_NEEDS = {"cm": [], "b": [], "casc": ["b"], "acc": ["cm", "casc"], "pairs": ["b"], "net": ["pairs"], "groups": ["pairs"], "coh": ["groups", "net", "casc"], "roles": ["acc", "coh"], "steps": ["b"]}


def _with(*names: str, shared: int = MIN_SHARED) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS[n]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    parts = []
    for n in order:
        text = _CTES[n].replace("{score}", _SCORE).replace("{min}", str(shared))
        if n == "roles":
            for k in ("media", "business", "journalist", "public_figure"):
                text = text.replace("{" + k + "}", _word(k))
        parts.append(text)
    return ("WITH RECURSIVE " if {"net", "pairs"} & set(order) else "WITH ") + ",\n".join(parts) + "\n"


_TOKENS = """
WITH u AS (SELECT row_id, author_handle, unnest({t}[1:least(len({t}), len({t}_raw))]) AS token, unnest({t}_raw[1:least(len({t}), len({t}_raw))]) AS raw,
  unnest(range(least(len({t}), len({t}_raw)))) AS pos FROM tweets),
a AS (SELECT DISTINCT token, author_handle FROM u)
SELECT token, arg_min(raw, struct_pack(r := row_id, p := pos)) AS display_token, count(*) AS "count", count(DISTINCT author_handle) AS unique_account_count,
  (SELECT string_agg(h, '|' ORDER BY h) FROM (SELECT author_handle AS h FROM a WHERE a.token IS NOT DISTINCT FROM u.token ORDER BY 1 LIMIT 10)) AS sample_accounts
FROM u GROUP BY token
"""
_TOKENS = _TOKENS.replace(
    "(SELECT string_agg(h, '|' ORDER BY h) FROM (SELECT author_handle AS h FROM a WHERE a.token IS NOT DISTINCT FROM u.token ORDER BY 1 LIMIT 10))",
    "array_to_string(list_sort(list(DISTINCT author_handle))[1:10], '|')",
)

_MIX = """mix AS (SELECT {k}, string_agg(label || ':' || {two}, '; ' ORDER BY n DESC, seen) AS mix FROM (
  SELECT {k}, label, n, seen, sum(n) OVER (PARTITION BY {k}) AS total FROM (SELECT {k}, coalesce(role_label, 'unknown') AS label, sum(n)::BIGINT AS n, min(seen) AS seen
    FROM cnt LEFT JOIN roles ON roles.account_handle = cnt.account_handle GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, seen) <= 4) GROUP BY {k})"""


def _mix(key: str) -> str:
    # two digits, half to even on the exact binary value as a decimal format does
    return _MIX.replace("{k}", key).replace("{two}", "format('{:.2f}', n / total)")


_PRE = _with("casc")
_NODES = """SELECT account_handle, component_id, component_size, neighbor_count, weighted_degree, within_15m_weight, within_60m_weight, strongest_neighbor, max_shared_edge FROM nodes"""
ORACLE = {
    "dataset_stats": _with("cm")
    + """SELECT (SELECT count(*) FROM cm) AS member_count, count(*) AS tweet_count, count(DISTINCT author_handle) AS active_account_count, count(*) FILTER (is_retweet) AS retweet_count,
    count(*) FILTER (NOT is_retweet) AS original_count, min(posted_at) AS date_start, max(posted_at) AS date_end,
    count(DISTINCT author_handle) FILTER (author_handle NOT IN (SELECT screen_name FROM cm)) AS missing_member_count,
    min(author_handle) FILTER (author_handle NOT IN (SELECT screen_name FROM cm)) AS first_missing_member FROM tweets""",
    "missing_members": _with("cm") + "SELECT DISTINCT author_handle AS account_handle FROM tweets WHERE author_handle NOT IN (SELECT screen_name FROM cm)",
    "cascade_summary": _PRE
    + """SELECT casc.*, floor((epoch_us(last_retweet_at) - epoch_us(first_retweet_at)) / 60000000)::BIGINT AS span_minutes, x.* EXCLUDE (o), y.retweeters FROM casc
    JOIN (SELECT o, array_to_string(list_filter(hashtags, lambda t, i: list_position(hashtags, t) = i), '|') AS hashtags, array_to_string(list_filter(mentions, lambda t, i: list_position(mentions, t) = i), '|') AS mentions,
      trim(replace(content_text, chr(10), ' ')) AS sample_text FROM b WHERE rn = 1) x ON x.o = original_tweet_id
    JOIN (SELECT o, string_agg(author_handle, '|' ORDER BY rn) AS retweeters FROM (SELECT o, author_handle, min(rn) AS rn FROM b GROUP BY 1, 2) GROUP BY 1) y ON y.o = original_tweet_id""",
    "source_cascades": _PRE
    + """SELECT original_author_handle, sum(retweet_count)::BIGINT AS total_retweet_count, count(*) AS unique_retweeted_tweet_count, any_value(k.n) AS unique_retweeter_count,
    min(first_retweet_at) AS first_retweet_at, max(last_retweet_at) AS last_retweet_at, sum(retweets_within_15m)::BIGINT AS total_retweets_within_15m,
    sum(retweets_within_60m)::BIGINT AS total_retweets_within_60m, arg_max(original_tweet_id, struct_pack(n := retweet_count, t := coalesce(first_retweet_at, original_created_at), i := original_tweet_id)) AS top_cascade_tweet_id,
    max(retweet_count) AS top_cascade_retweet_count FROM casc JOIN (SELECT original_author_handle, count(DISTINCT author_handle) AS n FROM casc JOIN b ON o = original_tweet_id GROUP BY 1) k USING (original_author_handle)
    GROUP BY original_author_handle""",
    "token_hashtags": _TOKENS.replace("{t}", "hashtags"),
    "token_mentions": _TOKENS.replace("{t}", "mentions"),
    "amplifier_edges": 'SELECT author_handle AS retweeter, content_author_handle AS source_author, count(*) AS "count" FROM tweets WHERE is_retweet GROUP BY 1, 2',
    "account_overlap": _with("pairs") + "SELECT * FROM pairs",
    "account_summary": _with("acc") + "SELECT * FROM acc",
    "coordination_score": f"SELECT account_handle, {_SCORE} AS score FROM account_summary",
    "overlap_nodes": _with("net") + _NODES,
    "overlap_components": _with("net")
    + """SELECT component_id, node_count, edge_count, CASE WHEN node_count > 1 THEN round(2 * edge_count / (node_count * (node_count - 1)), 4) ELSE 0.0 END AS density,
    total_shared_retweets, total_within_15m, total_within_60m, top_accounts
    FROM (SELECT component_id, count(*) AS node_count, array_to_string(list(account_handle ORDER BY weighted_degree DESC, neighbor_count DESC, account_handle)[1:10], '|') AS top_accounts FROM nodes GROUP BY 1)
    JOIN (SELECT component_id, count(*) AS edge_count, sum(shared_retweets)::BIGINT AS total_shared_retweets, sum(shared_within_15m)::BIGINT AS total_within_15m, sum(shared_within_60m)::BIGINT AS total_within_60m
      FROM pairs JOIN nodes ON account_handle = account_a GROUP BY 1) USING (component_id)""",
    "tight_edges": _with("pairs")
    + "SELECT account_a AS a, account_b AS b, 4 * shared_within_15m + 2 * shared_within_60m + shared_retweets AS w FROM pairs WHERE shared_within_15m + shared_within_60m >= 2",
    "cohort_by_cascade": _with("coh") + "SELECT o AS original_tweet_id, array_to_string(ids, '|') AS cohort_ids FROM byc",
    "cohorts": _with("coh")
    + """SELECT cohort_id, m AS member_count, cascades AS cascade_count, tight AS median_time_tightness_sec, round(hhi, 4) AS target_concentration_hhi, tt AS top_target_author, tn AS top_target_count,
    targets AS unique_targets, coalesce(array_to_string(parts, '|'), '') AS component_ids, array_to_string(members, '|') AS members, top AS top_cascade_tweet_id,
    round(most / m, 4) AS top_cascade_member_share, cohort_score FROM coh""",
    "k_core": _with("pairs")
    + """, wb AS (SELECT account_a AS x, account_b AS y, shared_within_15m AS w FROM pairs WHERE shared_within_15m > 0
      UNION ALL SELECT account_b, account_a, shared_within_15m FROM pairs WHERE shared_within_15m > 0 AND account_a <> account_b),
    stays(level, turn, x, gone) AS (SELECT l, 0, x, true FROM (SELECT DISTINCT x FROM wb), range(1, 5) AS r(l)
      UNION ALL SELECT * FROM (WITH now AS (SELECT * FROM stays WHERE level IN (SELECT level FROM stays WHERE gone)),
        deg AS (SELECT n.level, n.x, sum(w) AS d FROM now n JOIN wb USING (x) JOIN now m ON m.level = n.level AND m.x = wb.y GROUP BY 1, 2),
        kept AS (SELECT level, x FROM deg WHERE d >= level)
        SELECT level, (SELECT max(turn) FROM now) + 1, x, (SELECT count(*) FROM now n WHERE n.level = k.level) > count(*) OVER (PARTITION BY level) FROM kept k)),
    last AS (SELECT level, max(turn) AS turn, count(DISTINCT turn) AS turns FROM stays GROUP BY 1)
    SELECT x AS account_handle, max(CASE WHEN NOT gone THEN level ELSE 0 END)::BIGINT AS core_rank FROM stays JOIN last USING (level, turn) GROUP BY 1
    UNION ALL SELECT x, 0 FROM (SELECT DISTINCT x FROM wb) WHERE x NOT IN (SELECT x FROM stays JOIN last USING (level, turn))""",
    "account_roles": _with("roles")
    + """SELECT account_handle, role_label, round(CASE role_label WHEN 'source_hub' THEN 0.9
      WHEN 'media_business' THEN least(0.99, 0.5 + CASE WHEN media OR business THEN 0.2 ELSE 0 END + CASE WHEN listed_count >= 100 THEN 0.15 ELSE 0 END + CASE WHEN followers_count >= 250000 THEN 0.15 ELSE 0 END)
      WHEN 'journalist_public_figure' THEN least(0.99, 0.75 + CASE WHEN is_blue_verified THEN 0.2 ELSE 0 END)
      WHEN 'amplifier_suspect' THEN least(0.99, 0.55 + CASE WHEN retweet_ratio >= 0.95 THEN 0.1 ELSE 0 END + CASE WHEN original_count = 0 THEN 0.1 ELSE 0 END
        + CASE WHEN top_amplified_share >= 0.5 THEN 0.1 ELSE 0 END + CASE WHEN cids IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN first_retweeter_count >= 3 THEN 0.05 ELSE 0 END)
      WHEN 'retail_user' THEN 0.6 WHEN 'mixed_behavior' THEN 0.4 ELSE 0.2 END::DOUBLE, 4) AS role_confidence, in_member_list AS is_member,
    concat_ws('|', CASE WHEN media THEN 'description_media_keyword' END, CASE WHEN business THEN 'description_business_keyword' END, CASE WHEN journalist THEN 'description_journalist_keyword' END,
      CASE WHEN public_figure THEN 'description_public_figure_keyword' END, CASE WHEN listed_count >= 50 THEN 'listed_count>=50(' || listed_count || ')' END,
      CASE WHEN followers_count >= 100000 THEN 'followers>=100k(' || followers_count || ')' END,
      CASE WHEN ff >= 25 THEN 'followers_friends_ratio>=25(' || CASE WHEN isinf(ff) THEN 'inf' ELSE format('{:.1f}', ff) END || ')' END, CASE WHEN is_blue_verified THEN 'blue_verified' END,
      CASE WHEN default_profile THEN 'default_profile' END, CASE WHEN default_profile_image THEN 'default_profile_image' END,
      CASE WHEN retweet_ratio >= 0.85 AND tweet_count >= 5 THEN 'retweet_ratio>=0.85(' || printf('%.2f', round(retweet_ratio, 2)) || ')' END,
      CASE WHEN original_count <= 1 AND tweet_count >= 5 THEN 'zero_or_single_original' END,
      CASE WHEN first_retweeter_count >= 3 THEN 'first_retweeter_count>=3(' || first_retweeter_count || ')' END,
      CASE WHEN top_amplified_share >= 0.6 AND retweet_count >= 5 THEN 'top_amplified_share>=0.6(' || printf('%.2f', round(top_amplified_share, 2)) || ')' END,
      CASE WHEN cids IS NOT NULL THEN 'cohort_member(' || len(cids) || ')' END) AS signals,
    followers_count, friends_count, round(ff, 4) AS followers_friends_ratio, listed_count, profile_description_language AS description_language,
    length(trim(coalesce(d, ''))) AS description_length, is_blue_verified, default_profile,
    CASE WHEN account_created_at IS NOT NULL THEN greatest(floor((epoch_us((SELECT max(posted_at) FROM tweets)) - epoch_us(account_created_at)) / 86400000000), 0)::BIGINT END AS account_age_days, retweet_ratio, original_count, coalesce(array_to_string(cids, '|'), '') AS cohort_ids FROM roles""",
    "target_summary": _with("net", "roles")
    + """, x AS (SELECT content_author_handle AS t, author_handle AS account_handle, count(*) AS n, min(row_id) AS seen, count(DISTINCT o) AS p FROM b WHERE content_author_handle <> '' GROUP BY 1, 2),
    cnt AS (SELECT * FROM x),
    tot AS (SELECT t, sum(n)::BIGINT AS total, count(*) AS accounts, sum(n * n) / (sum(n) * sum(n)) AS hhi, arg_max(account_handle, struct_pack(n := n, s := -seen)) AS top, max(n) AS topn FROM x GROUP BY 1),
    """
    + _mix("t")
    + """, posts AS (SELECT content_author_handle AS t, count(DISTINCT o) AS n FROM b GROUP BY 1),
    reach2 AS (SELECT t, count(DISTINCT component_id) AS parts FROM x JOIN nodes USING (account_handle) GROUP BY 1),
    lag AS (SELECT original_author_handle AS t, (epoch_us(first_retweet_at) - epoch_us(original_created_at)) / 1000000 AS s, * FROM casc),
    lags AS (SELECT t, floor(median(trunc(s)) FILTER (s >= 0))::BIGINT AS med, arg_min(first_retweeter, struct_pack(q := coalesce(s, 0), h := first_retweeter)) FILTER (first_retweet_at IS NOT NULL AND coalesce(s, 0) >= 0) AS fast,
      sum(retweets_within_15m)::BIGINT AS w15, sum(retweets_within_60m)::BIGINT AS w60 FROM lag GROUP BY 1),
    led AS (SELECT t, first_retweeter AS h, count(*) AS n FROM lag GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, first_retweeter) = 1),
    five AS (SELECT t, original_tweet_id AS o, row_number() OVER (PARTITION BY t ORDER BY retweet_count DESC, coalesce(first_retweet_at, original_created_at), original_tweet_id) AS k FROM lag QUALIFY k <= 5),
    sets AS (SELECT t, k, list(DISTINCT author_handle) AS s FROM five JOIN b USING (o) GROUP BY 1, 2),
    crew AS (SELECT p.t, avg(len(list_intersect(p.s, q.s)) / (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))) AS j FROM sets p JOIN sets q ON p.t = q.t AND p.k < q.k GROUP BY 1)
    SELECT t AS amplified_author_handle, t IN (SELECT screen_name FROM cm) AS in_member_list, total AS total_inbound_retweets, accounts AS unique_amplifier_count, posts.n AS unique_amplified_posts,
    top AS top_amplifier_handle, topn AS top_amplifier_count, round(topn / total, 4) AS top_amplifier_share, round(hhi, 4) AS amplification_hhi, round(coalesce(j, 0), 4) AS repeat_crew_overlap,
    med AS median_first_retweet_lag_sec, fast AS fastest_amplifier_handle, coalesce(parts, 0) AS cross_component_reach, coalesce(w15, 0) AS within_15m_inbound, coalesce(w60, 0) AS within_60m_inbound,
    led.h AS top_first_retweeter_handle, coalesce(led.n, 0) AS top_first_retweeter_count, mix AS captured_role_mix,
    round(8 * ln(1 + total) + 25 * hhi + 20 * coalesce(j, 0) + 4 * ln(1 + coalesce(w15, 0)) - CASE WHEN coalesce(parts, 0) >= 1 THEN 5 * least(parts / accounts, 1) ELSE 0 END, 4) AS amplification_score
    FROM tot JOIN posts USING (t) JOIN mix USING (t) LEFT JOIN reach2 USING (t) LEFT JOIN lags USING (t) LEFT JOIN led USING (t) LEFT JOIN crew USING (t)""",
    "propagation": _with("net", "roles", "steps")
    + """, cnt AS (SELECT original_tweet_id, account_handle, count(*) AS n, min(rn) AS seen FROM steps GROUP BY 1, 2), """
    + _mix("original_tweet_id")
    + """, win AS (SELECT *, count(*) OVER (PARTITION BY original_tweet_id ORDER BY elapsed RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS w FROM steps),
    burst AS (SELECT original_tweet_id, max(elapsed) FILTER (rn = 5) AS k5, max(elapsed) FILTER (rn = 10) AS k10, max(elapsed) FILTER (rn = 50) AS k50,
      CASE WHEN count(*) >= 4 AND min(elapsed) < max(elapsed) THEN kurtosis_pop(elapsed) ELSE 0.0 END AS kurt, max(w) AS peak, arg_max(elapsed, struct_pack(w := w, e := -elapsed)) AS peak_at FROM win GROUP BY 1),
    cl AS (SELECT original_tweet_id, source_client, count(*) AS n, min(rn) AS seen FROM steps WHERE source_client <> '' GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY original_tweet_id ORDER BY count(*) DESC, min(rn)) = 1),
    parts AS (SELECT original_tweet_id, array_to_string(list_sort(list(DISTINCT component_id)), '|') AS ids FROM cnt JOIN nodes USING (account_handle) GROUP BY 1),
    pre AS (SELECT s.original_tweet_id, string_agg(s.account_handle || '@+' || elapsed || 's[c' || coalesce(component_id, 0) || '/h' || coalesce(byc.ids[1], 0) || ']', ' -> ' ORDER BY rn) AS p
      FROM steps s LEFT JOIN nodes ON nodes.account_handle = s.account_handle LEFT JOIN byc ON byc.o = s.original_tweet_id WHERE rn <= 5 GROUP BY 1),
    lead AS (SELECT first_retweeter, count(*) AS n FROM casc GROUP BY 1)
    SELECT c.original_tweet_id, original_author_handle, original_author_handle IN (SELECT screen_name FROM cm) AS origin_is_member, retweet_count, unique_retweeter_count, c.first_retweeter, lead.n AS first_retweeter_recurrence,
    k5 AS time_to_k5_sec, k10 AS time_to_k10_sec, k50 AS time_to_k50_sec, round(kurt, 4) AS burst_kurtosis, peak_at AS burst_peak_window_start_sec, peak AS burst_peak_window_count,
    round(coalesce(cl.n / retweet_count, 0), 4) AS same_client_share, source_client AS dominant_client, coalesce(parts.ids, '') AS amplifier_component_ids, coalesce(array_to_string(byc.ids, '|'), '') AS amplifier_cohort_ids,
    mix AS amplifier_role_mix, round(8 * ln(1 + retweet_count) + coalesce(greatest(0, 25 - least(k10, 3600) / 180), 0) + 1.5 * greatest(0, least(kurt, 10)) + 12 * coalesce(cl.n / retweet_count, 0)
      + 6 * ln(1 + coalesce(len(byc.ids), 0)), 4) AS propagation_score, p AS spread_path_preview
    FROM casc c JOIN burst USING (original_tweet_id) JOIN mix USING (original_tweet_id) JOIN pre USING (original_tweet_id) JOIN lead ON lead.first_retweeter = c.first_retweeter
    LEFT JOIN cl USING (original_tweet_id) LEFT JOIN parts USING (original_tweet_id) LEFT JOIN byc ON byc.o = c.original_tweet_id""",
    "spread_path": _with("coh", "steps")
    + """SELECT original_tweet_id, original_author_handle, first_retweet_at, steps FROM casc JOIN (SELECT original_tweet_id,
    string_agg(s.account_handle || ',' || elapsed || ',' || coalesce(component_id, 0) || ',' || coalesce(byc.ids[1], 0), '|' ORDER BY rn) AS steps
      FROM steps s LEFT JOIN nodes USING (account_handle) LEFT JOIN byc ON byc.o = s.original_tweet_id GROUP BY 1) USING (original_tweet_id)""",
    "first_profiles": _with("net", "roles")
    + """, x AS (SELECT first_retweeter AS account_handle, original_author_handle AS t, count(*) AS n FROM casc GROUP BY 1, 2),
    y AS (SELECT account_handle, count(*) AS u, arg_min(t, struct_pack(n := -n, t := t)) AS top, max(n) AS topn, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM x GROUP BY 1),
    z AS (SELECT first_retweeter AS account_handle, count(*) AS n, floor(median(CASE WHEN retweet_count >= 2 THEN floor(trunc((epoch_us(last_retweet_at) - epoch_us(first_retweet_at)) / 1000000) / (retweet_count - 1)) END))::BIGINT AS lag FROM casc GROUP BY 1)
    SELECT account_handle, z.n AS first_retweeter_count, u AS unique_targets_first, top AS top_target_author, topn AS top_target_count, round(hhi, 4) AS target_hhi, lag AS median_lag_to_second_retweet_sec,
    coalesce(role_label, 'unknown') AS role_label, coalesce(array_to_string(cids, '|'), '') AS cohort_ids, component_id FROM y JOIN z USING (account_handle) LEFT JOIN roles USING (account_handle) LEFT JOIN nodes USING (account_handle)""",
    "feature_matrix": _with("net", "roles")
    + """, lead AS (SELECT first_retweeter AS account_handle, count(*) AS leads FROM casc GROUP BY 1)
    SELECT account_handle, tweet_count, retweet_count, original_count, quote_count, retweet_ratio, first_retweeter_count, unique_retweeted_tweet_count, unique_retweeted_author_count, retweets_to_member_count,
    retweets_to_member_ratio, top_amplified_count, top_amplified_share, hashtag_count, mention_count, followers_count, friends_count, statuses_count,
    CASE WHEN account_created_at IS NOT NULL THEN greatest(floor((epoch_us((SELECT max(posted_at) FROM tweets)) - epoch_us(account_created_at)) / 86400000000), 0)::BIGINT END AS account_age_days,
    default_profile::BIGINT AS default_profile, default_profile_image::BIGINT AS default_profile_image, is_blue_verified::BIGINT AS is_blue_verified,
    coalesce(component_size, 0) AS network_component_size, coalesce(neighbor_count, 0) AS network_neighbor_count, coalesce(weighted_degree, 0) AS network_weighted_degree,
    coalesce(within_15m_weight, 0) AS network_within_15m_weight, coalesce(within_60m_weight, 0) AS network_within_60m_weight, coalesce(max_shared_edge, 0) AS network_max_shared_edge,
    coalesce(cn, 0) AS cohort_count, coalesce(cm1, 0) AS cohort_max_size, coalesce(cm2, 0) AS cohort_max_cascade_count, (role_label = 'retail_user')::BIGINT AS role_retail_user, (role_label = 'amplifier_suspect')::BIGINT AS role_amplifier_suspect,
    (role_label = 'media_business')::BIGINT AS role_media_business, (role_label = 'journalist_public_figure')::BIGINT AS role_journalist_public_figure, (role_label = 'source_hub')::BIGINT AS role_source_hub,
    round(first_retweeter_count / (SELECT count(*) FROM casc), 4) AS first_retweeter_ratio, coalesce(leads, 0) AS propagation_lead_count, coordination_score, '' AS analyst_label
    FROM roles LEFT JOIN nodes USING (account_handle) LEFT JOIN lead USING (account_handle)
    LEFT JOIN (SELECT account_handle, count(*) AS cn, max(m) AS cm1, max(cascades) AS cm2 FROM incoh JOIN coh USING (cohort_id) GROUP BY 1) USING (account_handle)""",
    "client_label": """SELECT raw_id, CASE WHEN s = '' THEN NULL ELSE coalesce(nullif(trim(regexp_extract(s, '>([^<]+)<', 1)), ''), s) END AS client
    FROM (SELECT raw_id, json_extract_string(payload, '$.source') AS s FROM raw_posts WHERE json_valid(payload))""",
    "handle_from_url": """SELECT DISTINCT screen_name, given, screen_name AS handle FROM (SELECT screen_name, unnest(['https://social.example/' || screen_name || '/status/1', ' @' || screen_name, screen_name || '/']) AS given FROM members)""",
    "members_placeholder": _with("cm")
    + """SELECT screen_name, member_id, followers_count, is_blue_verified FROM cm
    UNION ALL SELECT h, h, 0, false FROM (SELECT min(h) AS h FROM (SELECT DISTINCT nullif(trim(regexp_replace(trim(unnest(mentions_raw)), '^@', '')), '') AS h FROM tweets) WHERE h IS NOT NULL GROUP BY lower(h))
    WHERE lower(h) NOT IN (SELECT lower(screen_name) FROM cm)""",
    "snapshot_asof": """SELECT DISTINCT export_id, coalesce((SELECT max(snapshot_id) FROM members m WHERE m.snapshot_id <= t.export_id), (SELECT max(snapshot_id) FROM members)) AS snapshot_id FROM tweets t""",
}

ORACLE |= {
    "target_hhi": """SELECT t AS target, round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi FROM (SELECT content_author_handle AS t, count(*) AS n FROM tweets WHERE is_retweet
      GROUP BY content_author_handle, author_handle) GROUP BY t""",
    "repeat_crew": _with("casc")
    + """, five AS (SELECT original_author_handle AS t, original_tweet_id AS o, row_number() OVER (PARTITION BY original_author_handle
      ORDER BY retweet_count DESC, coalesce(first_retweet_at, original_created_at), original_tweet_id) AS k FROM casc QUALIFY k <= 5),
    sets AS (SELECT t, k, list(DISTINCT author_handle) AS s FROM five JOIN b USING (o) GROUP BY 1, 2)
    SELECT t AS original_author_handle, round(coalesce(any_value(j), 0), 6) AS repeat_overlap FROM five LEFT JOIN (SELECT p.t, avg(len(list_intersect(p.s, q.s)) / (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))) AS j
      FROM sets p JOIN sets q ON p.t = q.t AND p.k < q.k GROUP BY 1) USING (t) GROUP BY t""",
    "burst": _with("steps")
    + """, win AS (SELECT *, count(*) OVER (PARTITION BY original_tweet_id ORDER BY elapsed RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS w FROM steps)
    SELECT original_tweet_id, max(elapsed) FILTER (rn = 5) AS time_to_k5_sec, max(elapsed) FILTER (rn = 10) AS time_to_k10_sec, max(elapsed) FILTER (rn = 50) AS time_to_k50_sec,
      round(CASE WHEN count(*) >= 4 AND min(elapsed) < max(elapsed) THEN kurtosis_pop(elapsed) ELSE 0.0 END, 5) AS kurtosis, max(w) AS burst_peak_window_count,
      arg_max(elapsed, struct_pack(w := w, e := -elapsed)) AS burst_peak_window_start_sec FROM win GROUP BY 1""",
    "client_share": _with("steps")
    + """, cl AS (SELECT original_tweet_id, source_client, count(*) AS n FROM steps WHERE source_client <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY original_tweet_id ORDER BY count(*) DESC, min(rn)) = 1)
    SELECT original_tweet_id, any_value(cl.source_client) AS dominant_client, round(coalesce(any_value(n) / count(*), 0), 6) AS share FROM steps LEFT JOIN cl USING (original_tweet_id) GROUP BY 1""",
    "role_mix": _with("roles")
    + ", cnt AS (SELECT content_author_handle AS target, author_handle AS account_handle, count(*) AS n, min(row_id) AS seen FROM tweets WHERE is_retweet GROUP BY 1, 2), "
    + _mix("target")
    + " SELECT target, mix AS role_mix FROM mix",
    "burst_windows": """SELECT time_bucket(INTERVAL 15 MINUTE, posted_at) AS window_start, time_bucket(INTERVAL 15 MINUTE, posted_at) + INTERVAL 15 MINUTE AS window_end, content_tweet_id, count(*) AS amplifications, count(DISTINCT author_handle) AS accounts
      FROM tweets WHERE is_retweet AND posted_at IS NOT NULL GROUP BY 1, 2, 3""",
}

_AT = "core.user_results.result.core"
_LONG = "note_tweet.note_tweet_results.result"


def _said(doc: str, path: str) -> str:
    return f"CASE WHEN json_type({doc}, '$.{path}') = 'VARCHAR' THEN {doc} ->> '$.{path}' END"


def _there(path: str) -> str:
    return f"coalesce(json_extract(p, '$.{path}')::VARCHAR NOT IN ('null', 'false', '0', '\"\"', '[]', '{{}}'), false)"


def _when(doc: str) -> str:
    return f"""timezone('UTC', try_strptime(regexp_replace(trim({doc} ->> '$.legacy.created_at'), '^[A-Za-z]{{3}},?\\s+', ''), ['%b %d %H:%M:%S %z %Y', '%d %b %Y %H:%M:%S %z'])::TIMESTAMPTZ)"""


def _body(doc: str) -> str:
    note = _said(doc, f"{_LONG}.text")
    return f"coalesce(CASE WHEN trim({note}) <> '' THEN {note} END, {_said(doc, 'legacy.full_text')}, '')"


def _listed(kind: str, field: str) -> str:
    first, second = f"$.{_LONG}.entity_set.{kind}", f"$.legacy.entities.{kind}"
    items = f"CASE WHEN json_type(c, '{first}') = 'ARRAY' THEN c -> '{first}' WHEN json_type(c, '{second}') = 'ARRAY' THEN c -> '{second}' ELSE '[]'::JSON END"
    return f"array_to_string(list_filter(json_extract_string({items}, '$[*].{field}'), lambda t: t IS NOT NULL AND t <> ''), '|')"


ORACLE["normalised_posts"] = f"""
WITH g AS MATERIALIZED (SELECT raw_id, payload::JSON AS p FROM raw_posts WHERE payload IS NOT NULL AND json_valid(payload)),
b AS (SELECT raw_id, p, {_there("legacy.retweeted_status_result")} AS boost FROM g),
d AS MATERIALIZED (SELECT *, CASE WHEN boost AND json_type(p, '$.legacy.retweeted_status_result.result.tweet') = 'OBJECT' THEN p -> '$.legacy.retweeted_status_result.result.tweet'
  WHEN boost AND json_type(p, '$.legacy.retweeted_status_result.result') = 'OBJECT' THEN p -> '$.legacy.retweeted_status_result.result' ELSE p END AS c FROM b),
r AS (SELECT raw_id, coalesce(p ->> '$.rest_id', '') AS tweet_id, {_said("p", _AT + ".screen_name")} AS author_handle, {_said("p", _AT + ".name")} AS author_name, {_when("p")} AS posted_at,
  {_said("p", "source")} AS src, {_body("p")} AS text, boost AS is_retweet, {_there("legacy.is_quote_status")} OR {_there("quoted_status_result")} AS is_quote,
  nullif({_said("c", "rest_id")}, '') AS i1, nullif({_said("c", "legacy.id_str")}, '') AS i2, nullif({_said("c", _AT + ".screen_name")}, '') AS a1, {_said("c", _AT + ".name")} AS content_author_name,
  {_when("c")} AS content_created_at, {_body("c")} AS content_text, {_listed("hashtags", "text")} AS hashtags_raw, {_listed("user_mentions", "screen_name")} AS mentions_raw FROM d)
SELECT raw_id, tweet_id, author_handle, author_name, posted_at, CASE WHEN src = '' THEN NULL ELSE coalesce(nullif(trim(regexp_extract(src, '>([^<]+)<', 1)), ''), src) END AS source_client, text,
  is_retweet, is_quote, coalesce(i1, i2, tweet_id) AS content_tweet_id, coalesce(a1, nullif(regexp_extract(text, '^RT @([A-Za-z0-9_]{{1,32}}):', 1), ''), author_handle) AS content_author_handle,
  content_author_name, content_created_at, content_text, hashtags_raw, mentions_raw FROM r WHERE author_handle <> ''
"""

_X = {f: f"coalesce({f}::DOUBLE, 0)" if f in PLAIN else f"ln(1 + greatest(coalesce({f}::DOUBLE, 0), 0))" for f in FEATURES}
ORACLE["ml_features"] = "SELECT account_handle, " + ", ".join(f"round({x}, 6) AS {f}" for f, x in _X.items()) + " FROM (SELECT DISTINCT * FROM ml_feature_matrix)"
ORACLE["ml_scaled"] = (
    "WITH x AS (SELECT account_handle, " + ", ".join(f"{x} AS {f}" for f, x in _X.items()) + " FROM (SELECT DISTINCT * FROM ml_feature_matrix)), s AS (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + " FROM x) SELECT account_handle, "
    + ", ".join(f"CASE WHEN s_{f} > 0 THEN round(({f} - m_{f}) / s_{f}, 5) ELSE 0 END AS {f}" for f in FEATURES) + " FROM x, s"
)
