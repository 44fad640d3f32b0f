"""Queries of the shapes that a wiki's pages ask for, over stand-ins for its tables."""

from __future__ import annotations

#: Stand-in views over the given tables; their text is both the dialect's and DuckDB's.
VIEWS = {
    "page": "SELECT p_partkey AS page_id, p_partkey % 16 AS page_namespace, 'page ' || p_partkey AS page_title, p_partkey AS page_latest, p_size AS page_counter, p_brand AS page_touched FROM part",
    "page_restrictions": "SELECT p_partkey AS pr_page, p_type AS pr_type, p_size AS pr_level FROM part WHERE p_size > 30",
    "page_props": "SELECT p_partkey AS pp_page, CASE WHEN p_size > 25 THEN 'hiddencat' ELSE 'other' END AS pp_propname, p_brand AS pp_value FROM part",
    "revision": "SELECT o_orderkey AS rev_id, o_orderkey % 2000 AS rev_page, o_custkey % 7 * o_custkey AS rev_user, o_orderkey % 200 AS rev_text_id, o_orderpriority AS rev_comment FROM orders",
    "user": "SELECT c_custkey AS user_id, c_name AS user_name FROM customer",
    "text": "SELECT doc_id AS old_id, text AS old_text, lang AS old_flags FROM documents",
    "image": "SELECT url AS img_name, length(html) AS img_size, page_id AS img_width FROM pages",
    "job": "SELECT event_id AS job_id, event_type AS job_cmd, user_id AS job_namespace FROM events",
    "msg_resource": "SELECT c_mktsegment AS mr_resource, CASE WHEN c_nationkey < 12 THEN 'en' ELSE 'de' END AS mr_lang, c_name AS mr_blob FROM customer",
    "interwiki": "SELECT r_name AS iw_prefix, r_regionkey AS iw_local FROM region",
    "user_newtalk": "SELECT c_custkey AS user_id, c_name AS user_ip FROM customer",
}

_REVISION = "FROM revision INNER JOIN page ON page_id = rev_page LEFT JOIN user ON rev_user <> 0 AND user_id = rev_user"
#: name -> query in the dialect; the texts are DuckDB's as well, but for the quoted names
QUERIES = {
    "get_page_cols": "SELECT page_id, page_title, page_latest FROM page WHERE page_namespace = '0' AND page_title = 'page 16' LIMIT 1",
    "get_page_restrictions": "SELECT * FROM page_restrictions WHERE pr_page = 40",
    "get_category_links": "SELECT page_id, page_title, pp_value FROM page LEFT JOIN page_props ON pp_propname = 'hiddencat' AND pp_page = page_id WHERE page_namespace = '14' AND page_title IN ('page 30', 'page 45', 'page 46')",
    "get_user_info": "SELECT page_id, page_namespace FROM page WHERE page_namespace = '2' AND page_title = 'page 2' OR page_namespace = '3' AND page_title = 'page 3' OR page_namespace = '4' AND page_id < 50",
    "get_user_talk": "SELECT user_id FROM user_newtalk WHERE user_ip = 'Customer#000000007' LIMIT 1",
    "check_static_version": "SELECT page_id, page_title FROM page WHERE page_namespace = '8' AND page_title IN ('page 8', 'page 24', 'page 40', 'page 56')",
    "check_noscript_version": "SELECT page_id FROM page WHERE page_namespace = '8' AND page_title = 'page 8'",
    "check_message_resources": "SELECT mr_blob, mr_resource FROM msg_resource WHERE mr_resource IN ('BUILDING', 'MACHINERY') AND mr_lang = 'en'",
    "job_mgmt": "SELECT job_id, job_cmd FROM job WHERE job_id >= 0 ORDER BY job_id LIMIT 1",
    "fetch_from_conds": f"SELECT rev_id, page_title, user_name {_REVISION} WHERE page_id = 45 AND rev_id = 45 LIMIT 1",
    "load_text": "SELECT old_text, old_flags FROM text WHERE old_id = 5 LIMIT 1",
    "load_stub_text": f"SELECT rev_id, page_id, user_id {_REVISION} WHERE page_namespace = 6 AND rev_id = page_latest",
    "add_link_obj": "SELECT page_id, page_latest FROM page WHERE page_namespace = '10' AND page_title = 'page 10' LIMIT 1",
    "iw_if": "SELECT iw_prefix, iw_local FROM interwiki WHERE iw_prefix = '#if'",
    "iw_ifeq": "SELECT iw_prefix, iw_local FROM interwiki WHERE iw_prefix = 'ASIA'",
    "iw_iferror": "SELECT iw_prefix, iw_local FROM interwiki WHERE iw_prefix = 'EUROPE'",
    "iw_switch": "SELECT iw_prefix, iw_local FROM interwiki WHERE iw_prefix = 'AFRICA'",
    "iw_wikipedia": "SELECT iw_prefix, iw_local FROM interwiki WHERE iw_prefix = 'AMERICA'",
    "get_img_pg": "SELECT page_id FROM page WHERE page_namespace = '6' AND page_title = 'page 6' LIMIT 1",
    "get_bad_img_list": "SELECT `page`.`page_title`, `revision`.`rev_comment` FROM `revision` INNER JOIN `page` ON `page_id` = `rev_page` LEFT JOIN `user` ON `user_id` = `rev_user` WHERE `page_namespace` = 5 AND `rev_id` < 3000",
    "get_img": "SELECT img_name, img_size, img_width FROM image WHERE img_width = 3 LIMIT 1",
    "get_links": "SELECT page_id, page_namespace, page_title FROM page WHERE page_namespace = '0' AND page_title IN ('page 16', 'page 32') OR page_namespace = '14' AND page_title IN ('page 14', 'page 30')",
    "preload_existence": "SELECT page_id, page_namespace, page_title FROM page WHERE page_namespace = '2' AND page_title = 'page 2' OR page_namespace = '3' AND page_title = 'page 19'",
    "check_newtalk": "SELECT user_id FROM user_newtalk WHERE user_id = 12",
}
#: name -> (statements, query, DuckDB SQL) on tables made from the views
UPDATES = {
    "update_page_stats": (["CREATE TABLE stats AS SELECT * FROM page", "UPDATE stats SET page_counter = page_counter + 1 WHERE page_id = 7"], "SELECT page_id, page_counter FROM stats", "SELECT p_partkey AS page_id, p_size + CASE WHEN p_partkey = 7 THEN 1 ELSE 0 END AS page_counter FROM part"),
    "update_site_stats": (["CREATE TABLE site_stats (ss_row_id INTEGER PRIMARY KEY, ss_total_views INTEGER)", "INSERT INTO site_stats SELECT r_regionkey, r_regionkey * 10 FROM region", "UPDATE site_stats SET ss_total_views = ss_total_views + 1"], "SELECT ss_row_id, ss_total_views FROM site_stats", "SELECT r_regionkey::BIGINT AS ss_row_id, (r_regionkey * 10 + 1)::BIGINT AS ss_total_views FROM region"),
}


def duck(name: str) -> str:
    """The DuckDB SQL of a query: the stand-ins as common tables before it."""
    views = ", ".join(f'"{v}" AS ({sql})' for v, sql in VIEWS.items())
    text = QUERIES[name].replace("`", '"')
    for v in ("user", "text"):
        text = text.replace(f" {v} ", f' "{v}" ')
    return f"WITH {views} {text}"
