"""The registered queries of the pipe language and their SQL.

Most are a script over one table; the few that need files of their own write them to
the shared folder first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _script(name: str, table: str, script: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).run(script.replace("$DIR", sf_dir), f"{sf_dir}/{table}.parquet").frame()

    run.__name__ = name
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _csv_script(name: str, table: str, columns: list[str], script: str, sql: str) -> None:
    """The script over a CSV copy of some columns of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.writers import write_csv

        engine, path = Engine(spark), shared_path(spark, "csv")
        write_csv(engine.run("cols " + ",".join(columns), f"{sf_dir}/{table}.parquet"), path)
        return engine.run(script, path).frame()

    run.__name__ = name
    _QUERIES[name], _SQL[name] = run, sql


S = _script
S("select_numeric", "lineitem", "select l_quantity > 45 && l_linenumber <= 2 | cols l_orderkey,l_linenumber,l_quantity",
  "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_linenumber <= 2")
S("select_string", "lineitem", "select l_returnflag == 'R' | cols l_orderkey,l_linenumber,l_returnflag",
  "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
S("select_auto", "lineitem", "select l_quantity < l_linenumber | cols l_orderkey,l_linenumber,l_quantity",
  "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < l_linenumber")
S("select_regex", "part", "select p_name =~ '(?i)^[a-p].*[[:alnum:]]$' && p_brand !~ '#1\\d' | cols p_partkey,p_name,p_brand",
  "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_name, '(?i)^[a-p].*[[:alnum:]]$') AND NOT regexp_matches(p_brand, '#1[0-9]')")
S("select_affix", "orders", "select o_orderpriority ^= '1' || o_orderpriority $= 'LOW' || o_orderpriority *= 'NOT' | cols o_orderkey,o_orderpriority",
  "SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1') OR ends_with(o_orderpriority, 'LOW') OR contains(o_orderpriority, 'NOT')")
S("select_not", "orders", "select -v o_orderstatus == 'F' || o_totalprice > 300000 | cols o_orderkey,o_orderstatus,o_totalprice",
  "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 300000)")
S("select_bool_ops", "orders", "select !(o_totalprice > 1000 && o_totalprice < 200000) && (o_orderstatus == 'O' || o_custkey % 2 == 0) | cols o_orderkey",
  "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 1000 AND o_totalprice < 200000) AND (o_orderstatus = 'O' OR o_custkey % 2 = 0)")
S("cols_keep", "nation", "cols n_name,n_nationkey", "SELECT n_name, n_nationkey FROM nation")
S("cols_exclude", "customer", "cols -v c_name,c_acctbal", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
S("cols_range", "orders", "cols 2-3 o_orderdate:o_orderpriority", "SELECT o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
S("cols_positional", "customer", "cols 5,1", "SELECT c_mktsegment, c_custkey FROM customer")
S("rename", "nation", "rename n_name=name n_regionkey = region", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
S("add_arith", "lineitem", "add revenue = l_extendedprice * (1 - l_discount) + l_tax / 2 | add m = -l_linenumber % 3 | cols l_orderkey,l_linenumber,revenue,m",
  "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax / 2 AS revenue, (-l_linenumber)::DOUBLE % 3::DOUBLE AS m FROM lineitem")
S("add_ternary", "lineitem", "add band = l_quantity > 40 ? 'high' : l_quantity > 20 ? 'mid' : 'low' | cols l_orderkey,l_linenumber,band",
  "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS band FROM lineitem")
S("add_concat", "customer", "add tag = c_mktsegment ++ '/' ++ c_nationkey | cols c_custkey,tag",
  "SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS tag FROM customer")
S("add_bool", "customer", "add rich = (c_acctbal > 5000) ++ '' | add same = (c_acctbal > 0) == (c_nationkey > 12) | cols c_custkey,rich,same",
  "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 't' ELSE 'f' END AS rich, CASE WHEN (c_acctbal > 0) = (c_nationkey > 12) THEN 't' ELSE 'f' END AS same FROM customer")
S("fn_math", "customer", "add a = abs(c_acctbal) | add r = round(c_acctbal) | add f = floor(c_acctbal) | add c = ceil(c_acctbal) | add i = int(c_acctbal) | add s = round(sqrt(a) * 1000) | add g = sign(c_acctbal) | add p = pow(c_nationkey, 2) | cols c_custkey,a,r,f,c,i,s,g,p",
  "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal)::DOUBLE AS r, floor(c_acctbal)::DOUBLE AS f, ceil(c_acctbal)::DOUBLE AS c, trunc(c_acctbal)::DOUBLE AS i, round(sqrt(abs(c_acctbal)) * 1000)::DOUBLE AS s, sign(c_acctbal)::DOUBLE AS g, pow(c_nationkey, 2)::DOUBLE AS p FROM customer")
S("fn_string", "part", "add u = upper(p_name) | add l = lower(p_brand) | add n = len(p_type) | add t = trim('  ' ++ p_type ++ ' ') | cols p_partkey,u,l,n,t",
  "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type)::DOUBLE AS n, p_type AS t FROM part")
S("fn_minmax", "lineitem", "add lo = min(l_quantity, l_linenumber * 8, 30) | add hi = max(l_quantity, 10) | cols l_orderkey,l_linenumber,lo,hi",
  "SELECT l_orderkey, l_linenumber, least(l_quantity, l_linenumber * 8.0, 30.0)::DOUBLE AS lo, greatest(l_quantity, 10.0)::DOUBLE AS hi FROM lineitem")
S("fn_coalesce", "orders", "add c = coalesce(o_orderstatus == 'F' ? '' : o_orderstatus, o_orderpriority, 'none') | cols o_orderkey,c",
  "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS c FROM orders")
S("cast_num", "orders", "add n = num(o_orderkey ++ '.5') + 1 | cols o_orderkey,n", "SELECT o_orderkey, o_orderkey + 1.5::DOUBLE AS n FROM orders")
S("cast_str", "lineitem", "add s = str(l_quantity) | cols l_orderkey,l_linenumber,s", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS s FROM lineitem")
S("prev_delta", "events", "sort event_id | add d = round((value - prev(value)) * 100) | cols event_id,d",
  "SELECT event_id, round((value - coalesce(lag(value) OVER (ORDER BY event_id), value)) * 100)::DOUBLE AS d FROM events")
S("rownum_mod", "events", "sort event_id | select rownum() % 7 == 0 | cols event_id", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n % 7 = 0")
S("prev_changed", "events", "sort event_id | select event_type != prev(event_type) | cols event_id,event_type",
  "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE event_type <> p")
S("context_before_after", "events", "sort event_id | select -B 1 -A 2 value > 400 | cols event_id",
  "SELECT event_id FROM (SELECT event_id, max((value > 400)::INT) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS hit FROM events) WHERE hit = 1")
S("sort_head", "orders", "sort o_totalprice=nr o_orderkey | head 20 | cols o_orderkey,o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
S("sort_multi", "customer", "sort c_mktsegment=s c_acctbal=nr c_custkey | head 100 | cols c_custkey,c_mktsegment", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 100")
S("tail_n", "orders", "sort o_orderkey | tail 15 | cols o_orderkey,o_custkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 15")
S("tail_from", "nation", "sort n_nationkey | tail +21", "SELECT * FROM nation ORDER BY n_nationkey OFFSET 20")
S("head_neg", "nation", "sort n_nationkey | head -n -5", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 20")
S("topk", "lineitem", "agg total=sum(l_quantity) by l_orderkey | sort total=nr l_orderkey | head 10", "SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
S("uniq_row", "lineitem", "cols l_returnflag,l_linestatus,l_linenumber | uniq", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
S("uniq_key", "events", "sort event_id | uniq user_id | cols user_id,event_id", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
S("agg_count", "orders", "agg count by o_orderstatus", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
S("agg_count_col", "events", "agg count(props) by event_type", "SELECT event_type, count(CASE WHEN props <> '' THEN 1 END) AS props_count FROM events GROUP BY 1")
S("agg_distinct", "events", "agg count_distinct(user_id) by event_type", "SELECT event_type, count(DISTINCT user_id) AS user_id_count_distinct FROM events GROUP BY 1")
S("agg_sum_mean", "lineitem", "agg s=sum(l_quantity) m=mean(l_quantity) by l_returnflag | add m = round(m * 1000000)", "SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_quantity) * 1000000)::DOUBLE AS m FROM lineitem GROUP BY 1")
S("agg_minmax", "orders", "agg min(o_totalprice), max(o_totalprice), lo=min(o_orderpriority) by o_orderstatus", "SELECT o_orderstatus, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, min(o_orderpriority) AS lo FROM orders GROUP BY 1")
S("agg_stddev", "lineitem", "agg d=stddev(l_quantity) by l_linestatus | add d = round(d * 1000000)", "SELECT l_linestatus, round(stddev_samp(l_quantity) * 1000000)::DOUBLE AS d FROM lineitem GROUP BY 1")
S("agg_global", "lineitem", "agg n=count q=sum(l_quantity)", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem")
S("agg_multi_key", "lineitem", "agg n=count by l_returnflag,l_linestatus | select n > 100", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 100")
S("agg_named", "orders", "agg big=max(o_totalprice), n=count by 3", "SELECT o_orderstatus, max(o_totalprice) AS big, count(*) AS n FROM orders GROUP BY 1")
S("stats_profile", "supplier", "stats s_suppkey,s_nationkey,s_name | cols field,count,empty,min,max,sum",
  "SELECT 's_suppkey' AS field, count(s_suppkey) AS count, count(*) - count(s_suppkey) AS empty, min(s_suppkey)::VARCHAR AS min, max(s_suppkey)::VARCHAR AS max, sum(s_suppkey)::DOUBLE AS sum FROM supplier UNION ALL SELECT 's_nationkey', count(s_nationkey), count(*) - count(s_nationkey), min(s_nationkey)::VARCHAR, max(s_nationkey)::VARCHAR, sum(s_nationkey)::DOUBLE FROM supplier UNION ALL SELECT 's_name', count(s_name), count(*) - count(s_name), min(s_name), max(s_name), NULL FROM supplier")
S("join_inner", "orders", "join $DIR/customer.parquet on o_custkey=c_custkey | cols o_orderkey,c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
S("join_left", "customer", "join -l (select o_totalprice > 400000) $DIR/orders.parquet on c_custkey=o_custkey | cols c_custkey,o_orderkey",
  "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
S("join_right", "orders", "select o_totalprice > 400000 | join -r $DIR/customer.parquet on o_custkey=c_custkey | cols o_custkey,o_orderkey,c_name",
  "SELECT c_custkey AS o_custkey, o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 400000) RIGHT JOIN customer ON o_custkey = c_custkey")
S("join_full", "nation", "select n_nationkey > 2 | rename n_nationkey=k | join -F (select s_nationkey < 20 | agg n=count by s_nationkey) $DIR/supplier.parquet on k=s_nationkey | cols k,n_name,n",
  "SELECT coalesce(n_nationkey, s_nationkey) AS k, n_name, n FROM (SELECT * FROM nation WHERE n_nationkey > 2) FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey < 20 GROUP BY 1) ON n_nationkey = s_nationkey")
S("join_composite", "lineitem", "join (agg m=max(l_quantity) by l_orderkey,l_linenumber) $DIR/lineitem.parquet on l_orderkey,l_linenumber | cols l_orderkey,l_linenumber,m",
  "SELECT a.l_orderkey, a.l_linenumber, m FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
S("join_alias", "nation", "join $DIR/region.parquet on n_regionkey=r_regionkey | cols n_name,r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
S("join_sub", "nation", "join (select c_acctbal > 9000 | agg rich=count by c_nationkey) $DIR/customer.parquet on n_nationkey=c_nationkey | cols n_name,rich",
  "SELECT n_name, rich FROM nation JOIN (SELECT c_nationkey, count(*) AS rich FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON n_nationkey = c_nationkey")
S("join_multi", "customer", "join $DIR/nation.parquet on c_nationkey=n_nationkey, $DIR/region.parquet on n_regionkey=r_regionkey | cols c_custkey,n_name,r_name",
  "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
S("join_suffix", "nation", "join -L _a -R _b $DIR/nation.parquet on n_nationkey | cols n_nationkey,n_name_a,n_name_b",
  "SELECT n_nationkey, n_name AS n_name_a, n_name AS n_name_b FROM nation")
S("fn_fragment", "lineitem", "fn over(col, n) { select col > n | agg k=count, total=sum(col) by l_returnflag } over(l_quantity, 30)",
  "SELECT l_returnflag, count(*) AS k, sum(l_quantity) AS total FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
S("hist_data", "lineitem", "graph hist l_quantity -b 7 -D",
  "WITH b AS (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem), c AS (SELECT least(floor(((l_quantity / 2 - lo / 2) / (hi / 2 - lo / 2)) * 7), 6)::INT AS i, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT CASE WHEN g = 0 THEN lo ELSE lo * (1 - g / 7.0::DOUBLE) + hi * (g / 7.0::DOUBLE) END AS bin_lo, CASE WHEN g = 6 THEN hi ELSE lo * (1 - (g + 1) / 7.0::DOUBLE) + hi * ((g + 1) / 7.0::DOUBLE) END AS bin_hi, coalesce(n, 0) AS count FROM range(7) t(g) CROSS JOIN b LEFT JOIN c ON c.i = g")
S("bar_data", "orders", "agg n=count by o_orderpriority | graph bar o_orderpriority n -D", "SELECT o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY 1")
S("xy_data", "part", "select p_size > 45 | graph scatter p_partkey p_retailprice -D", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 45")
S("heatmap_data", "lineitem", "graph heatmap l_linenumber l_quantity -b 4 -D",
  "WITH b AS (SELECT min(l_linenumber)::DOUBLE x0, max(l_linenumber)::DOUBLE x1, min(l_quantity) y0, max(l_quantity) y1 FROM lineitem), c AS (SELECT least(floor(((l_linenumber / 2.0::DOUBLE - x0 / 2) / (x1 / 2 - x0 / 2)) * 4), 3)::INT i, least(floor(((l_quantity / 2 - y0 / 2) / (y1 / 2 - y0 / 2)) * 4), 3)::INT j, count(*) n FROM lineitem, b GROUP BY 1, 2) SELECT CASE WHEN i = 0 THEN x0 ELSE x0 * (1 - i / 4.0::DOUBLE) + x1 * (i / 4.0::DOUBLE) END AS l_linenumber, CASE WHEN j = 0 THEN y0 ELSE y0 * (1 - j / 4.0::DOUBLE) + y1 * (j / 4.0::DOUBLE) END AS l_quantity, n AS count FROM c, b")
S("select_agg_flagship", "lineitem", "select l_quantity > 45 && l_returnflag == 'R' | agg n=count, avg_price=mean(l_extendedprice) by l_linestatus | add avg_price = round(avg_price * 100)",
  "SELECT l_linestatus, count(*) AS n, round(avg(l_extendedprice) * 100)::DOUBLE AS avg_price FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' GROUP BY 1")
S("select_nan", "lineitem", "add q = l_quantity > 25 ? num('nan') : l_quantity | select l_linenumber < q || l_linenumber == nan | cols l_orderkey,l_linenumber,q",
  "SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_quantity <= 25 AND l_linenumber < l_quantity")
S("select_infinite", "lineitem", "select l_quantity < inf && l_quantity > -inf && l_quantity != nan && l_linenumber > 5 | cols l_orderkey,l_linenumber",
  "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 5")
S("fn_exp_logs", "customer", "add x = abs(c_acctbal) + 1 | add e = round(exp(c_nationkey / 10) * 1000000) | add l = round(log(x) * 1000000) | add t = round(log10(x) * 1000000) | add w = round(log2(x) * 1000000) | add z = log(0) | cols c_custkey,e,l,t,w,z",
  "SELECT c_custkey, round(exp(c_nationkey / 10.0::DOUBLE) * 1000000)::DOUBLE AS e, round(ln(abs(c_acctbal) + 1) * 1000000)::DOUBLE AS l, round(log10(abs(c_acctbal) + 1) * 1000000)::DOUBLE AS t, round(log2(abs(c_acctbal) + 1) * 1000000)::DOUBLE AS w, '-inf'::DOUBLE AS z FROM customer")
S("fn_pow_special", "customer", "add a = pow(1, nan) | add b = pow(-1, inf) | add c = pow(c_nationkey, 0.5) | add c = round(c * 1000000) | cols c_custkey,a,b,c",
  "SELECT c_custkey, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, round(sqrt(c_nationkey) * 1000000)::DOUBLE AS c FROM customer")
S("cast_str_fractions", "customer", "add s = str(c_acctbal) | add t = str(c_acctbal / 4) | cols c_custkey,s,t",
  "SELECT c_custkey, regexp_replace(regexp_replace(printf('%.2f', c_acctbal), '0+$', ''), '\\.$', '') AS s, regexp_replace(regexp_replace(printf('%.4f', c_acctbal / 4), '0+$', ''), '\\.$', '') AS t FROM customer")
S("agg_float_key", "lineitem", "agg n=count by l_discount,l_tax", "SELECT l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY 1, 2")
S("prev_after_agg", "events", "sort event_id | agg n=count, first=min(event_id) by user_id | sort user_id | add d = n - prev(n) | cols user_id,n,first,d",
  "WITH g AS (SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1) SELECT user_id, n, first, (n - coalesce(lag(n) OVER (ORDER BY user_id), n))::DOUBLE AS d FROM g")
S("rownum_unsorted", "events", "add r = rownum() | agg low=min(r), high=max(r), n=count", "SELECT 1.0::DOUBLE AS low, count(*)::DOUBLE AS high, count(*) AS n FROM events")
S("rownum_after_sort", "lineitem", "sort l_shipdate l_orderkey l_linenumber | select rownum() % 1000 == 0 | cols l_orderkey,l_linenumber",
  "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n % 1000 = 0")
S("tail_from_large", "lineitem", "sort l_extendedprice=nr l_orderkey l_linenumber | tail +2001 | agg n=count, top=max(l_extendedprice)",
  "SELECT count(*) AS n, max(l_extendedprice) AS top FROM (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber OFFSET 2000)")
S("head_neg_large", "orders", "sort o_totalprice o_orderkey | head -n -500 | agg n=count, top=max(o_totalprice)",
  "SELECT count(*) AS n, max(o_totalprice) AS top FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT (SELECT greatest(count(*) - 500, 0) FROM orders))")
S("context_wide", "orders", "sort o_orderkey | select -B 5 -A 9 o_totalprice > 480000 | cols o_orderkey",
  "SELECT o_orderkey FROM (SELECT o_orderkey, max((o_totalprice > 480000)::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN 9 PRECEDING AND 5 FOLLOWING) AS hit FROM orders) WHERE hit = 1")
S("uniq_first_of_key", "lineitem", "uniq l_partkey | agg n=count", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
S("time_axis", "orders", "select o_totalprice > 450000 | graph line o_orderdate o_totalprice -D", "SELECT o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 450000")
S("head_tail_fold", "nation", "sort n_nationkey | tail +4 | head 10 | tail 3 | cols n_nationkey", "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 10 AND 12")
S("quoted_names", "nation", "rename `n_name`='the name' | select `the name` *= '1' | add `a b` = `the name` ++ '!' | cols 'a b' | rename 'a b'=ab", "SELECT n_name || '!' AS ab FROM nation WHERE contains(n_name, '1')")
S("fragment_quoted_brace", "nation", "fn mark(c) { add m = c ++ '}' | cols m } mark(n_name)", "SELECT n_name || '}' AS m FROM nation")
_csv_script("csv_scan", "supplier", ["s_suppkey", "s_name", "s_nationkey"], "select s_nationkey >= 10 | add k = num(s_suppkey) | cols s_name,s_nationkey,k",
  "SELECT s_name, s_nationkey::VARCHAR AS s_nationkey, s_suppkey::DOUBLE AS k FROM supplier WHERE s_nationkey >= 10")
_csv_script("csv_auto_sort", "customer", ["c_custkey", "c_acctbal", "c_mktsegment"], "sort c_acctbal c_custkey | head 25 | cols c_custkey",
  "SELECT c_custkey::VARCHAR AS c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
_csv_script("csv_agg", "customer", ["c_custkey", "c_acctbal", "c_mktsegment"], "agg n=count s=sum(c_custkey) lo=min(c_custkey) d=count_distinct(c_acctbal) by c_mktsegment",
  "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::DOUBLE AS s, min(c_custkey)::VARCHAR AS lo, count(DISTINCT c_acctbal) AS d FROM customer GROUP BY 1")
_csv_script("csv_prev", "events", ["event_id", "value"], "sort event_id=n | add p = prev(event_id) | select event_id > prev(event_id) | cols event_id,p",
  "SELECT event_id::VARCHAR AS event_id, p::VARCHAR AS p FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p FROM events) WHERE event_id > p")


_csv_script("csv_mixed_sort", "part", ["p_partkey", "p_size", "p_name"], "add k = p_size % 3 == 0 ? '' : p_size % 3 == 1 ? p_name : p_size | sort k p_partkey=n | head 2000 | select rownum() % 50 == 0 | cols p_partkey",
  "SELECT p_partkey::VARCHAR AS p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3 = 1, CASE p_size % 3 WHEN 0 THEN 0 WHEN 2 THEN p_size END, CASE WHEN p_size % 3 = 1 THEN p_name END, p_partkey) AS n FROM part) WHERE n % 50 = 0 AND n <= 2000")
_csv_script("csv_blank_keys", "part", ["p_partkey", "p_size", "p_name"], "select p_size <= 20 | add k = p_size > 10 ? '' : p_size | agg n=count, m=count(k) by k",
  "SELECT CASE WHEN p_size > 10 THEN '' ELSE p_size::VARCHAR END AS k, count(*) AS n, count(CASE WHEN p_size <= 10 THEN 1 END) AS m FROM part WHERE p_size <= 20 GROUP BY 1")


def _headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV copy whose first line is taken as a row, with names given apart."""
    from ..sources.writers import write_csv

    engine, path = Engine(spark), shared_path(spark, "csv")
    write_csv(engine.run("cols n_nationkey,n_name", f"{sf_dir}/nation.parquet"), path, header=False)
    return engine.run("select key >= 20 | cols key,name", path, header="key,name").frame()


def _from_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a pattern in the shared folder, joined by key, their columns marked by what the pattern stood for."""
    from ..sources.writers import write_csv

    engine, folder = Engine(spark), shared_path(spark, "pattern")
    for part in (2, 10):
        write_csv(engine.run(f"select n_nationkey >= {part} | cols n_nationkey,n_name", f"{sf_dir}/nation.parquet"), f"{folder}/nation.{part}.csv")
    return engine.run(f"from '{folder}/nation.10.csv' on n_nationkey | join {folder}/nation.{{2,10}}.csv on n_nationkey | cols -v n_name").frame()


_QUERIES["csv_headerless"], _SQL["csv_headerless"] = _headerless, "SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation WHERE n_nationkey >= 20"
_QUERIES["join_pattern"], _SQL["join_pattern"] = _from_pattern, "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS n_name_2, n_name AS n_name_10 FROM nation WHERE n_nationkey >= 10"


def _stream(name: str, table: str, script: str, sql: str) -> None:
    """The script as a stream over the table's rows, brought to its end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..streaming.pipeline import stream

        path = f"{sf_dir}/{table}.parquet"
        source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, path))
        frame, mode = stream(spark, script.replace("$DIR", sf_dir), source)
        title = f"millrace_{name}_{uuid.uuid4().hex[:8]}"
        query = frame.writeStream.format("memory").queryName(title).outputMode(mode).option("checkpointLocation", shared_path(spark, "stream")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(title)

    _QUERIES[name], _SQL[name] = run, sql


def _folder(spark: SparkSession, path: str) -> str:
    """A folder that holds the table's files alone, as streams read folders."""
    folder = shared_path(spark, "source")
    spark.read.parquet(path).write.parquet(folder)
    return folder


_stream("stream_rows", "orders", "select o_totalprice > 400000 | add k = o_totalprice / 1000 | cols o_orderkey,k", "SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders WHERE o_totalprice > 400000")
_stream("stream_agg", "orders", "agg n=count, top=max(o_totalprice) by o_orderstatus", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
_stream("stream_join", "nation", "join $DIR/region.parquet on n_regionkey=r_regionkey | cols n_name,r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def _from_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).run(f"from (select n_regionkey == 1) {sf_dir}/nation.parquet | cols n_name,n_nationkey").frame()


def _from_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).run(f"from {sf_dir}/nation.parquet, {sf_dir}/region.parquet on n_regionkey=r_regionkey | cols n_name,r_name").frame()


def _spark_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means depend on the order of addition in their last digits, so they are rounded."""
    df = Engine(spark).run("sort event_id | graph spark value -D -W 10", f"{sf_dir}/events.parquet").frame()
    return df.withColumn("value", F.round("value", 6))


_QUERIES["spark_data"] = _spark_data
_SQL["spark_data"] = """
WITH r AS (
  SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL
)
SELECT floor(((r + 1) * 10 - 1) / n::DOUBLE)::BIGINT + 1 AS bucket, round(avg(value), 6) AS value FROM r GROUP BY 1
"""
_QUERIES["from_single"], _SQL["from_single"] = _from_single, "SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1"
_QUERIES["from_joined"], _SQL["from_joined"] = _from_joined, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["select_agg_flagship"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
