"""The views of :mod:`pairspace.workload.views` as SQL, by name and by what they build on."""

from __future__ import annotations

SENTENCE_SPLIT = "[.!?\\n|]+"

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, *needs: str, sql: str) -> None:
    VIEWS[name] = (list(needs), sql)


def with_views(body: str, *names: str) -> str:
    """``body`` behind a WITH clause of the named views and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered)
    return f"WITH {clauses}\n{body}"


def _sentences(table: str, key: str) -> str:
    return f"""
    SELECT {key}, pos - 1 AS pos, trim(txt) AS text
    FROM (SELECT {key}, unnest(parts) AS txt, generate_subscripts(parts, 1) AS pos
          FROM (SELECT {key}, regexp_split_to_array(text, '[.!?\\n|]+') AS parts FROM {table}))
    WHERE trim(txt) <> ''"""


def _tokens(sentences: str) -> str:
    return f"""
    SELECT sid, text AS sentence, id, n, tok, pos,
           CASE pos WHEN 'NNS' THEN regexp_replace(low, 's$', '')
                    WHEN 'VBD' THEN regexp_replace(low, '(ed|ing)$', '')
                    ELSE low END AS lemma, low
    FROM (SELECT *, CASE
            WHEN low IN ('is','was','be','are') THEN 'VB'
            WHEN low IN ('and','or') THEN 'CC'
            WHEN low IN ('of','to','in','for','on','with','by','as','at','from') THEN 'IN'
            WHEN low IN ('the','a','an','this','that','it') THEN 'DT'
            WHEN regexp_matches(low, '^\\p{{L}}{{3,}}(ed|ing)$') THEN 'VBD'
            WHEN regexp_matches(low, '^\\p{{L}}{{3,}}ly$') THEN 'RB'
            WHEN regexp_matches(low, '^\\p{{L}}{{3,}}s$') THEN 'NNS'
            WHEN regexp_matches(low, '^\\p{{L}}{{2,}}$') THEN 'NN'
            ELSE 'SYM' END AS pos
          FROM (SELECT sid, text, unnest(ws) AS tok, lower(unnest(ws)) AS low,
                       generate_subscripts(ws, 1) AS id, len(ws) AS n
                FROM (SELECT sid, text,
                             list_filter(regexp_split_to_array(text, '[^\\p{{L}}]+'), lambda w: w <> '') AS ws
                      FROM {sentences})))"""


view("sentences", sql=_sentences("documents", "doc_id"))
view("sents", "sentences", sql="SELECT text, min(doc_id * 16777216 + pos) AS sid FROM sentences GROUP BY text")
view("toks", "sents", sql=_tokens("sents"))
view(
    "pairs",
    "toks",
    sql="""
    SELECT a.sid, a.lemma AS noun1, b.lemma AS noun2
    FROM toks a JOIN toks b ON a.sid = b.sid AND a.id < b.id
    WHERE a.pos IN ('NN', 'NNS') AND b.pos IN ('NN', 'NNS')""",
)
view("b_sentences", sql=_sentences("benchmark", "item_id"))
view("b_sents", "b_sentences", sql="SELECT item_id * 16777216 + pos AS sid, text FROM b_sentences")
view("b_toks", "b_sents", sql=_tokens("b_sents"))
view(
    "wanted",
    "b_toks",
    sql="""
    SELECT DISTINCT a.lemma AS noun1, b.lemma AS noun2
    FROM b_toks a JOIN b_toks b ON a.sid = b.sid AND a.id < b.id
    WHERE a.pos IN ('NN', 'NNS') AND b.pos IN ('NN', 'NNS')""",
)
# On a chain every connected token set is a window. Between two neighbouring
# nouns x and y it reaches over tokens that are no nouns, 3 to 6 tokens long.
view(
    "short_toks",
    "toks",
    sql="""
    SELECT *, pos IN ('NN', 'NNS') AS noun,
           count(*) OVER (PARTITION BY sid, lemma) AS lemma_n,
           coalesce(max(CASE WHEN pos IN ('NN', 'NNS') THEN id END)
             OVER (PARTITION BY sid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS noun_before,
           coalesce(min(CASE WHEN pos IN ('NN', 'NNS') THEN id END)
             OVER (PARTITION BY sid ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1) AS noun_after
    FROM toks""",
)
view(
    "windows",
    "short_toks",
    sql="""
    SELECT x.sid, x.sentence, x.id AS xi, y.id AS yi, x.lemma AS l1, y.lemma AS l2, x.low AS w1, y.low AS w2, a.a, b.b
    FROM short_toks x
    JOIN short_toks y ON y.sid = x.sid AND y.id = x.noun_after AND y.id - x.id <= 5
    CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS a) a
    CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS b) b
    WHERE x.noun AND x.id - a.a > x.noun_before AND y.id + b.b < y.noun_after
      AND y.id - x.id + 1 + a.a + b.b BETWEEN 3 AND 6
      AND CASE WHEN x.lemma = y.lemma THEN x.lemma_n = 2 ELSE x.lemma_n + y.lemma_n = 2 END""",
)
view(
    "feats",
    "windows",
    sql="""
    SELECT any_value(w.l1) AS noun1, any_value(w.l2) AS noun2,
           string_agg(CASE WHEN t.low = w.w1 THEN 'X' WHEN t.low = w.w2 THEN 'Y' ELSE t.low END, ' ' ORDER BY t.id) AS pattern,
           any_value(w.sentence) AS sentence
    FROM windows w JOIN short_toks t ON t.sid = w.sid AND t.id BETWEEN w.xi - w.a AND w.yi + w.b
    GROUP BY w.sid, w.xi, w.yi, w.a, w.b""",
)
view(
    "pair_pattern",
    "feats",
    sql="SELECT noun1, noun2, pattern, count(*) AS freq FROM feats GROUP BY ALL",
)
view(
    "jobim",
    "pair_pattern",
    sql="""
    SELECT jo, bim, sum(freq)::DOUBLE AS cnt FROM (
      SELECT noun1 AS jo, '@::' || pattern || '::' || noun2 AS bim, freq FROM pair_pattern UNION ALL
      SELECT noun1, noun2 || '::' || pattern || '^-1::@', freq FROM pair_pattern UNION ALL
      SELECT noun2, noun1 || '::' || pattern || '::@', freq FROM pair_pattern UNION ALL
      SELECT noun2, '@::' || pattern || '^-1::' || noun1, freq FROM pair_pattern UNION ALL
      SELECT pattern, noun1 || '::@::' || noun2, freq FROM pair_pattern UNION ALL
      SELECT pattern || '^-1', noun2 || '::@::' || noun1, freq FROM pair_pattern)
    GROUP BY jo, bim""",
)
view(
    "star",
    sql="""
    SELECT p_brand AS jo, n_name AS bim, sum(l_quantity) AS cnt
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey GROUP BY p_brand, n_name""",
)
view(
    "bought",
    sql="SELECT l_suppkey AS id, l_partkey AS idx, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
)


def scores_view(name: str, source: str, pooled: bool = True) -> None:
    scale = "2.0" if pooled else "1.0"
    view(
        name,
        source,
        sql=f"""
        SELECT j.jo, j.bim, j.cnt,
               log2((j.cnt / t.n) / ((a.n / ({scale} * t.n)) * (b.n / ({scale} * t.n)))) AS pmi,
               log2((j.cnt / t.n) / ((a.n / ({scale} * t.n)) * (b.n / ({scale} * t.n)))) / nullif(-log2(j.cnt / t.n), 0) AS npmi,
               log2((j.cnt / t.n) / ((a.n / ({scale} * t.n)) * (b.n / ({scale} * t.n)))) * j.cnt AS lmi
        FROM {source} j
        JOIN (SELECT jo, sum(cnt) AS n FROM {source} GROUP BY jo) a ON a.jo = j.jo
        JOIN (SELECT bim, sum(cnt) AS n FROM {source} GROUP BY bim) b ON b.bim = j.bim
        CROSS JOIN (SELECT sum(cnt) AS n FROM {source}) t""",
    )


scores_view("scores", "jobim")
scores_view("star_scores", "star")
scores_view("star_scores_separate", "star", pooled=False)


view("truth", sql="SELECT o_orderkey AS item, 'c' || o_custkey AS cluster FROM orders WHERE o_orderstatus IN ('F', 'P')")
view(
    "pred",
    sql="""SELECT o_orderkey AS item, o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m') AS cluster
           FROM orders WHERE o_orderstatus IN ('O', 'P')""",
)
view(
    "cells",
    "truth",
    "pred",
    sql="""SELECT t.cluster AS t, p.cluster AS p, count(*) AS n
           FROM truth t JOIN pred p ON t.item = p.item GROUP BY ALL""",
)
view("t_sizes", "truth", sql="SELECT cluster AS t, count(*) AS t_size FROM truth GROUP BY cluster")
view("p_sizes", "pred", sql="SELECT cluster AS p, count(*) AS p_size FROM pred GROUP BY cluster")
view("a_sizes", "cells", sql="SELECT t, sum(n)::BIGINT AS a FROM cells GROUP BY t")
view("b_sizes", "cells", sql="SELECT p, sum(n)::BIGINT AS b FROM cells GROUP BY p")

view(
    "distances",
    "bought",
    sql="""
    SELECT a.id AS row, b.id AS col,
           1 - sum(a.value * b.value) / greatest(any_value(na.norm) * any_value(nb.norm), sum(a.value * b.value)) AS distance
    FROM bought a JOIN bought b ON a.idx = b.idx AND a.id >= b.id
    JOIN (SELECT id, sqrt(sum(value * value)) AS norm FROM bought GROUP BY id) na ON na.id = a.id
    JOIN (SELECT id, sqrt(sum(value * value)) AS norm FROM bought GROUP BY id) nb ON nb.id = b.id
    GROUP BY a.id, b.id""",
)
LETTERS = "translate({}::VARCHAR, '0123456789', 'abcdefghij')"
view(
    "sims",
    "distances",
    sql=f"""
    SELECT 's::@::' || {LETTERS.format('l')} AS l_pair, 's::@::' || {LETTERS.format('r')} AS r_pair, similarity
    FROM (SELECT row AS l, col AS r, round((1 - distance) * 1000, 6) AS similarity FROM distances
          UNION ALL
          SELECT col, row, round((1 - distance) * 1000, 6) FROM distances WHERE row <> col)""",
)
view(
    "ranked_sims",
    "sims",
    sql="SELECT *, row_number() OVER (ORDER BY l_pair, similarity DESC, r_pair) AS pos FROM sims",
)
