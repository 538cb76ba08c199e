"""DuckDB SQL of the domain relations and of steps that several oracles share; with() puts in front what a query names."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "ratings": "SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, avg(l.l_quantity) / 5.0 AS rating FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2",
    "ratings_dense": "SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, avg(least(value, 50.0)) / 5.0 AS rating FROM events GROUP BY 1, 2",
    "items": "SELECT p_partkey AS item_id, p_name AS name, p_type || '|' || p_brand || '|' || replace(p_name, ' ', '|') AS tags, p_size % 30 AS cluster, p_retailprice AS price FROM part",
    "item_tags": "SELECT DISTINCT item_id, cluster, tag FROM (SELECT item_id, cluster, unnest(string_split(tags, '|')) AS tag FROM items)",
    "comments": "SELECT d.doc_id AS review_id, d.doc_id % 15 AS user_id, d.doc_id % 20 AS item_id, d.lang, d.text, CASE WHEN b.quality = 1 THEN 'positive' WHEN b.quality = 0 THEN 'negative' END AS polarity FROM documents d LEFT JOIN labels b ON b.doc_id = d.doc_id",
    "lemmas": r"SELECT review_id, user_id, item_id, polarity, pos, lower(tok) AS lemma FROM (SELECT review_id, user_id, item_id, polarity, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT *, list_filter(string_split(regexp_replace(text, '[[:punct:]\s]+', ' ', 'g'), ' '), lambda x: x <> '') AS toks FROM comments))",
    "phrases": "SELECT e.vec_id AS phrase_id, e.vec_id % 15 AS user_id, e.vec_id % 20 AS item_id, e.label AS cluster, e.embedding, d.text AS phrase FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id",
    "turns": r"SELECT conv_id, turn, text, len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n_words FROM conversations",
    "centered_dense": "SELECT user_id, item_id, rating, avg(rating) OVER (PARTITION BY user_id) AS mean, rating - avg(rating) OVER (PARTITION BY user_id) AS centered FROM ratings_dense",
    "norms": "SELECT user_id, sqrt(sum(rating * rating)) AS norm, sqrt(sum(centered * centered)) AS cnorm, count(*) AS m FROM centered_dense GROUP BY 1",
    "sums": "SELECT a.user_id AS u, b.user_id AS v, sum(a.rating * b.rating) AS dot, sum(a.centered * b.centered) AS cdot, sum((a.rating - b.rating) * (a.rating - b.rating)) AS sq, count(*) AS n FROM centered_dense a JOIN centered_dense b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2",
    "cos_both": "SELECT u, v, n, round(1 - coalesce(dot / nullif(x.norm * y.norm, 0), 0), 9) AS dist, round(1 - coalesce(cdot / nullif(x.cnorm * y.cnorm, 0), 0), 9) AS cdist, round(sqrt(sq / n), 9) AS edist, x.m AS mu_, y.m AS mv_ FROM sums JOIN norms x ON x.user_id = u JOIN norms y ON y.user_id = v",
    "all_pairs": "SELECT a.user_id AS u, b.user_id AS v, coalesce(p.dist, 1.0) AS dist, coalesce(p.cdist, 1.0) AS cdist FROM norms a JOIN norms b ON a.user_id <> b.user_id LEFT JOIN cos_both p ON p.u = a.user_id AND p.v = b.user_id",
    "knn": "SELECT * FROM (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS rank FROM all_pairs) WHERE rank <= 10",
    "knn_centered": "SELECT * FROM (SELECT u, v, cdist AS dist, row_number() OVER (PARTITION BY u ORDER BY cdist, v) AS rank FROM all_pairs) WHERE rank <= 10",
    "pred_mean": "SELECT u AS user_id, item_id, avg(rating) AS pred, count(*) AS n FROM knn_centered JOIN ratings_dense r ON r.user_id = v GROUP BY 1, 2",
    "split_user": "SELECT user_id, item_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY (user_id * 7919 + item_id * 104729) % 100003, item_id) <= floor(count(*) OVER (PARTITION BY user_id) * 0.3) AS hidden FROM ratings_dense",
    "split_all": "SELECT user_id, item_id, rating, row_number() OVER (ORDER BY (user_id * 7919 + item_id * 104729) % 100003, user_id, item_id) <= floor(count(*) OVER () * 0.2) AS hidden FROM ratings_dense",
    "own_norms": "SELECT user_id, sqrt(sum(rating * rating) FILTER (NOT hidden)) AS train_norm, sqrt(sum(rating * rating)) AS norm FROM split_user GROUP BY 1",
    "own_pairs": "SELECT a.user_id AS u, b.user_id AS v, sum(a.rating * b.rating) AS dot FROM split_user a JOIN split_user b ON a.item_id = b.item_id AND a.user_id <> b.user_id WHERE NOT a.hidden GROUP BY 1, 2",
    "own_ranked": "SELECT x.user_id AS u, y.user_id AS v, coalesce(round(1 - p.dot / nullif(x.train_norm * y.norm, 0), 9), 1.0) AS dist, row_number() OVER (PARTITION BY x.user_id ORDER BY coalesce(round(1 - p.dot / nullif(x.train_norm * y.norm, 0), 9), 1.0), y.user_id) AS rank FROM own_norms x JOIN own_norms y ON x.user_id <> y.user_id LEFT JOIN own_pairs p ON p.u = x.user_id AND p.v = y.user_id",
    "own_pred": "SELECT u AS user_id, item_id, avg(rating) AS pred FROM own_ranked JOIN ratings_dense r ON r.user_id = v WHERE rank <= 10 GROUP BY 1, 2",
    "own_err": "SELECT h.user_id, h.item_id, h.rating, p.pred, h.rating - p.pred AS err FROM split_user h JOIN own_pred p ON p.user_id = h.user_id AND p.item_id = h.item_id WHERE h.hidden",
}


def sql(query: str) -> str:
    """The query with the views that it names, and those that they name, in front."""
    order: list[str] = []

    def visit(text: str, inside: tuple = ()) -> None:
        for name in VIEWS:
            if name not in inside and name not in order and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name], (*inside, name))
                order.append(name)

    visit(query)
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)
    if not head:
        return query
    if query.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {query.lstrip()[15:]}"
    return f"WITH {head}, {query.lstrip()[5:]}" if query.lstrip().upper().startswith("WITH ") else f"WITH {head} {query}"


def r6(x: str, digits: int = 6) -> str:
    return f"(round({x} + 2.3e-10, {digits}) + 0.0)"
