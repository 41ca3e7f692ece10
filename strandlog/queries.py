"""The graph engine's queries over the driver tables, each with SQL that says the same in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlog import model as M
from strandlog.functions import ids as I
from strandlog.functions import scalars as X
from strandlog.functions import temporal as D
from strandlog.operators import resolve as R
from strandlog.operators import validate as K
from strandlog.operators import views as V
from strandlog.plans import oplog as L
from strandlog.plans.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def hexed(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: I.format_id(F.col(c)) for c in cols})


# ---- SQL building blocks -------------------------------------------------------------------------------------


def sid(expr: str, blob: bool = False) -> str:
    h = f"sha256({expr})"
    return f"(substr({h},1,12)||'8'||substr({h},14,3)||substr('89ab',(strpos('0123456789abcdef',substr({h},17,1))-1)%4+1,1)||substr({h},18,15))"


def lang(tag: str) -> str:
    return sid(f"'{I.LANGUAGE_PREFIX}{tag}'")


def prop(name: str) -> str:
    return sid(f"'property:{name}'")


_EVENTS = f"""
raw AS (SELECT event_id AS n, CASE WHEN event_id%5=0 THEN 'side' ELSE 'main' END AS space, {sid("'user:'||user_id")} AS id, event_type AS kind, value,
  CASE WHEN event_type='signup' THEN 1 WHEN event_type='click' AND event_id%4=0 THEN 4 WHEN event_type='error' AND event_id%2=0 THEN 3 ELSE 2 END AS op FROM events),
own AS (SELECT space, id, min(n) AS created FROM raw WHERE op=1 GROUP BY ALL),
seen AS (SELECT r.*, created, coalesce(last_value(CASE op WHEN 3 THEN 'D' WHEN 4 THEN 'A' END IGNORE NULLS) OVER (PARTITION BY r.space, r.id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),'A') AS before
  FROM raw r JOIN own o ON r.space=o.space AND r.id=o.id WHERE n>=created),
ok AS (SELECT * FROM seen WHERE CASE WHEN op=4 THEN before='D' ELSE before='A' END),
ent AS (SELECT o.space, o.id, o.created, CASE WHEN (SELECT arg_max(op,n) FROM ok k WHERE k.space=o.space AND k.id=o.id AND op IN (3,4))=3 THEN 'DELETED' ELSE 'ACTIVE' END AS status FROM own o)"""


def _slots(where: str = "true") -> str:
    return f"""
tak AS (SELECT * FROM ok WHERE {where}),
ev AS (
  SELECT space,id,n,1 AS seq,{prop("name")} AS property,NULL::VARCHAR AS language,'user '||n AS txt,NULL::BIGINT AS i64,NULL::VARCHAR AS unit,-1 AS mode FROM tak WHERE op=1
  UNION ALL SELECT space,id,n,1,{prop("score")},NULL,NULL,n,NULL,-1 FROM tak WHERE op=1
  UNION ALL SELECT space,id,n,1,{prop("title")},CASE n%3 WHEN 0 THEN NULL WHEN 1 THEN {lang("de")} ELSE {lang("fr")} END,'title '||n,NULL,NULL,-1 FROM tak WHERE kind='view'
  UNION ALL SELECT space,id,n,1,{prop("score")},NULL,NULL,CAST(round(value*100) AS BIGINT),{sid("'unit:cent'")},-1 FROM tak WHERE kind='purchase'
  UNION ALL SELECT space,id,n,1,{prop("score")},NULL,NULL,n,NULL,-1 FROM tak WHERE kind='click' AND n%4=3
  UNION ALL SELECT space,id,n,1,{prop("name")},NULL,'renamed '||n,NULL,NULL,-1 FROM tak WHERE kind='error' AND n%2=1
  UNION ALL SELECT space,id,n,0,{prop("title")},NULL,NULL,NULL,NULL,0 FROM tak WHERE kind='click' AND n%4=1
  UNION ALL SELECT space,id,n,0,{prop("title")},{lang("de")},NULL,NULL,NULL,2 FROM tak WHERE kind='click' AND n%4=2
  UNION ALL SELECT space,id,n,0,{prop("score")},NULL,NULL,NULL,NULL,1 FROM tak WHERE kind='click' AND n%4=3
  UNION ALL SELECT space,id,n,0,{prop("name")},NULL,NULL,NULL,NULL,1 FROM tak WHERE kind='click' AND n%4=3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY space,id,property,language ORDER BY n DESC, seq DESC) AS r FROM ev WHERE mode<>0),
vals AS (SELECT space,id,property,language,txt,i64,unit,n AS set_at FROM ranked x WHERE r=1 AND seq=1
  AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.mode=0 AND c.space=x.space AND c.id=x.id AND c.property=x.property AND c.n>x.n)),
live AS (SELECT v.* FROM vals v JOIN ent e ON v.space=e.space AND v.id=e.id WHERE e.status='ACTIVE')"""


_SLOTS = _slots()
_RELATIONS = f"""
rid AS (SELECT *, {sid("'order:'||o_custkey||'-'||(o_orderkey%3)")} AS id FROM orders),
made AS (SELECT id, min(o_orderkey) AS created FROM rid GROUP BY id),
rops AS (
  SELECT id,o_orderkey AS n,0 AS i,5 AS op,'a'||(o_orderkey%10) AS position,false AS clears FROM rid
  UNION ALL SELECT id,o_orderkey,1,6,CASE WHEN o_orderkey%10=0 THEN 'b'||(o_orderkey%7) END,o_orderkey%10=5 FROM rid WHERE o_orderkey%5=0
  UNION ALL SELECT id,o_orderkey,2,7,NULL,false FROM rid WHERE o_orderkey%7=0
  UNION ALL SELECT id,o_orderkey,3,8,NULL,false FROM rid WHERE o_orderkey%14=0),
rseen AS (SELECT r.*, created, coalesce(last_value(CASE op WHEN 7 THEN 'D' WHEN 8 THEN 'A' END IGNORE NULLS) OVER (PARTITION BY r.id ORDER BY n,i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),'A') AS before FROM rops r JOIN made m ON r.id=m.id),
rok AS (SELECT * FROM rseen WHERE CASE WHEN op=8 THEN before='D' WHEN op=5 THEN n=created ELSE before='A' END),
rstate AS (SELECT id, arg_max(CASE op WHEN 7 THEN 'DELETED' ELSE 'ACTIVE' END, n*10+i) AS status FROM rok WHERE op IN (5,7,8) GROUP BY id),
rpos AS (SELECT id, position FROM (SELECT id, position, row_number() OVER (PARTITION BY id ORDER BY n DESC,i DESC) AS r FROM rok WHERE op=5 OR (op=6 AND (clears OR position IS NOT NULL))) WHERE r=1),
rel AS (SELECT m.id, {sid("'relation:'||o_orderpriority")} AS type, {sid("'customer:'||o_custkey")} AS src, {sid("'status:'||o_orderstatus")} AS dst, p.position, s.status, m.created, o.o_custkey,
  CASE WHEN o_orderkey%4=0 AND m.id NOT IN (SELECT id FROM rok WHERE op=6 AND n%10=0) THEN {sid("'edit:'||o_orderkey")} END AS to_version FROM made m JOIN orders o ON o.o_orderkey=m.created JOIN rpos p ON p.id=m.id JOIN rstate s ON s.id=m.id),
arel AS (SELECT * FROM rel WHERE status='ACTIVE')"""
_REFS = f"""
refs AS (SELECT {sid("'ref:'||(l_partkey%50)")} AS ref_id, {sid("'supplier:'||l_suppkey")} AS entity, {sid("'property:'||l_returnflag")} AS property, CASE WHEN l_linestatus='O' THEN {lang("de")} END AS language, l_orderkey AS n, l_linenumber AS i, l_partkey%50 AS short FROM lineitem),
rown AS (SELECT ref_id, min(n*100+i) AS created FROM refs GROUP BY ref_id),
byslot AS (SELECT entity,property,language,arg_max(ref_id,n*100+i) AS ref_id,max(n*100+i) AS pos FROM refs GROUP BY entity,property,language)"""


def entity_state_of(spark, d):
    return R.State(L.entity_ops(spark, d))


def relation_state(spark, d):
    return R.State(L.relation_ops(spark, d))


def flat(values: DataFrame) -> DataFrame:
    out = values.select("space", "id", "property", "language", F.col("value.text").alias("txt"), F.col("value.i64").alias("i64"), F.col("value.unit").alias("unit"), F.col("set_at.block").alias("set_at"))
    return hexed(out, "id", "property", "language", "unit")


# ---- log and lifecycle ---------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS} SELECT space, op AS op_type, count(*) AS n_ops FROM raw GROUP BY ALL")
def scan_ops(spark, d):
    return L.entity_ops(spark, d).groupBy("space", F.col("op_type").cast("int").alias("op_type")).agg(F.count("*").alias("n_ops"))


@query(f"WITH {_EVENTS}, ok2 AS (SELECT * FROM raw), {_SLOTS.replace('FROM ok WHERE', 'FROM ok2 WHERE')} SELECT space, id, property, n AS block, txt, i64 FROM ev WHERE seq=1")
def explode_values(spark, d):
    e = R.slot_events(L.entity_ops(spark, d)).where("seq = 1")
    return hexed(e.select("space", "id", "property", F.col("ord.block").alias("block"), F.col("value.text").alias("txt"), F.col("value.i64").alias("i64")), "id", "property")


@query(f"WITH {_EVENTS} SELECT space, id, created, status FROM ent")
def entity_state(spark, d):
    return hexed(entity_state_of(spark, d).entities.select("space", "id", F.col("created.block").alias("created"), "status"), "id")


@query(f"WITH {_EVENTS} SELECT space, id, n AS block, op AS op_type FROM ok")
def tombstone_filter(spark, d):
    return hexed(entity_state_of(spark, d).accepted.select("space", "id", F.col("ord.block").alias("block"), F.col("op_type").cast("int").alias("op_type")), "id")


@query(f"WITH {_EVENTS}, w AS (SELECT DISTINCT CASE WHEN event_id%2=0 THEN 'main' ELSE 'side' END AS space, {sid("'user:'||(user_id+event_id%2)")} AS id FROM events) SELECT w.space, w.id, coalesce(e.status,'NOT_FOUND') AS status FROM w LEFT JOIN ent e ON w.space=e.space AND w.id=e.id")
def state_lookup(spark, d):
    e = L.read(spark, d, "events")
    wanted = e.select(F.when(F.col("event_id") % 2 == 0, "main").otherwise("side").alias("space"), L.named("user:", F.col("user_id") + F.col("event_id") % 2).alias("id")).distinct()
    return hexed(R.lookup(entity_state_of(spark, d).objects, wanted).select("space", "id", "status"), "id")


_CLAIM = f"""WITH c AS (SELECT {sid("'thing:'||(o_custkey%40)")} AS id, CASE o_orderkey%3 WHEN 0 THEN 'E' WHEN 1 THEN 'R' ELSE 'V' END AS kind, o_orderkey AS n FROM orders)"""


def _clashing(spark, d):
    o = L.read(spark, d, "orders")
    k, ident = F.col("o_orderkey"), L.named("thing:", F.col("o_custkey") % 40)
    make = lambda rest, op, **kw: L._frame(o.where(k % 3 == rest), op, k, F.lit(0), ident, **kw)
    return make(0, 1).unionByName(make(1, 5, relation=L._relation())).unionByName(make(2, 9))


@query(f"{_CLAIM}, o AS (SELECT id, arg_min(kind,n) AS kind, min(n) AS created FROM c GROUP BY id), r AS (SELECT {sid("encode('" + I.RELATION_ENTITY_PREFIX + "')||unhex(id)")} AS id, 'E' AS kind, created FROM o WHERE kind='R') SELECT * FROM o UNION ALL SELECT * FROM r")
def claims_namespace(spark, d):
    return hexed(R.owners_of(R.claims(_clashing(spark, d))).select("id", "kind", F.col("created.block").alias("created")), "id")


@query(f"{_CLAIM}, o AS (SELECT id, arg_min(kind,n) AS owner FROM c GROUP BY id) SELECT c.id, owner, kind, n AS block FROM c JOIN o ON c.id=o.id WHERE kind<>owner")
def namespace_collisions(spark, d):
    return hexed(R.collisions(R.claims(_clashing(spark, d))).select("id", "owner", "kind", F.col("ord.block").alias("block")), "id")


# ---- values --------------------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT * FROM live")
def slot_lww(spark, d):
    return flat(entity_state_of(spark, d).values)


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT * FROM vals")
def values_with_hidden(spark, d):
    return flat(entity_state_of(spark, d).values_all)


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT space, id, property, max(n) AS cleared FROM ev WHERE mode=0 GROUP BY ALL")
def unset_all(spark, d):
    e = R.slot_events(entity_state_of(spark, d).accepted).where("mode = 0")
    return hexed(e.groupBy("space", "id", "property").agg(F.max("ord.block").alias("cleared")), "id", "property")


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT space, id, property, language, n AS block FROM ranked WHERE r=1 AND seq=0")
def unset_language(spark, d):
    e = R.slot_events(entity_state_of(spark, d).accepted).where("mode IS NULL OR mode <> 0")
    last = e.groupBy("space", "id", "property", "language").agg(F.max_by(F.struct("seq", "ord"), F.struct("ord", "seq", "idx")).alias("x")).where("x.seq = 0")
    return hexed(last.select("space", "id", "property", "language", F.col("x.ord.block").alias("block")), "id", "property", "language")


@query(f"WITH {_EVENTS}, {_SLOTS}, p AS (SELECT *, row_number() OVER (PARTITION BY space,id ORDER BY CASE WHEN language={lang('fr')} THEN 0 WHEN language IS NULL THEN 1 ELSE 2 END, language) AS r FROM live WHERE property={prop('title')}) SELECT space,id,language,txt FROM p WHERE r=1")
def text_language_fallback(spark, d):
    v = entity_state_of(spark, d).values.where(F.col("property") == L.named("property:title"))
    out = V.language_choice(v, [I.language_id(F.lit("fr")), None])
    return hexed(out.select("space", "id", "language", F.col("value.text").alias("txt")), "id", "language")


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT space, coalesce(unit,'none') AS unit, count(*) AS n_values, sum(i64) AS total FROM live WHERE property={prop('score')} GROUP BY ALL")
def unit_replace(spark, d):
    v = entity_state_of(spark, d).values.where(F.col("property") == L.named("property:score"))
    return v.groupBy("space", F.coalesce(I.format_id(F.col("value.unit")), F.lit("none")).alias("unit")).agg(F.count("*").alias("n_values"), F.sum("value.i64").alias("total"))


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT space, id, max(CASE WHEN property={prop('name')} THEN txt END) AS name, max(CASE WHEN property={prop('title')} AND language IS NULL THEN txt END) AS title FROM live GROUP BY ALL")
def entity_pivot(spark, d):
    return hexed(V.pivot(entity_state_of(spark, d).values, {"name": L.named("property:name"), "title": L.named("property:title")}, "value.text"), "id")


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT space, id FROM live WHERE property={prop('score')} AND i64%2=0")
def property_equality(spark, d):
    v = entity_state_of(spark, d).values.where((F.col("property") == L.named("property:score")) & (F.col("value.i64") % 2 == 0))
    return hexed(v.select("space", "id"), "id")


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT property, CASE WHEN txt IS NULL THEN 2 ELSE 5 END AS data_type, count(*) AS n_values FROM live GROUP BY ALL")
def predicate_split(spark, d):
    v = entity_state_of(spark, d).values.groupBy("property", F.col("value.data_type").cast("int").alias("data_type")).agg(F.count("*").alias("n_values"))
    return hexed(v, "property")


@query(f"WITH {_EVENTS}, {_SLOTS} SELECT space, id, property, language, txt, i64 FROM live WHERE txt IS NULL")
def values_by_type(spark, d):
    v = flat(entity_state_of(spark, d).values.where("value.data_type = 2"))
    return v.select("space", "id", "property", "language", "txt", "i64")


_HALF = "(SELECT max(event_id)//2 FROM events)"


def _cut(spark, d):
    ops = L.entity_ops(spark, d)
    at = L.read(spark, d, "events").agg(F.floor(F.max("event_id") / 2).alias("at"))
    return ops.join(F.broadcast(at), F.col("ord.block") <= F.col("at")).drop("at")


_AS_OF = f"{_EVENTS.replace('FROM events)', 'FROM events WHERE event_id<=' + _HALF + ')')}"


@query(f"WITH {_AS_OF}, {_SLOTS} SELECT * FROM live")
def as_of_state(spark, d):
    return flat(R.State(_cut(spark, d)).values)


_BEFORE = _slots(f"n<={_HALF}")


@query(f"""WITH {_EVENTS}, {_SLOTS.replace("live AS", "nolive AS")}, late AS (SELECT space,id,property,language,coalesce(txt,i64::varchar) AS new FROM vals),
b AS (WITH {_BEFORE.replace("live AS", "nolive AS")} SELECT space,id,property,language,coalesce(txt,i64::varchar) AS old FROM vals)
SELECT coalesce(b.space,a.space) AS space, coalesce(b.id,a.id) AS id, coalesce(b.property,a.property) AS property, coalesce(b.language,a.language) AS language, old, new,
CASE WHEN b.space IS NULL THEN 'added' WHEN a.space IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN late a ON b.space=a.space AND b.id=a.id AND b.property=a.property AND b.language IS NOT DISTINCT FROM a.language WHERE old IS DISTINCT FROM new""")
def state_diff(spark, d):
    show = lambda s: s.values_all.withColumn("v", F.coalesce("value.text", F.col("value.i64").cast("string")))
    out = V.diff(show(R.State(_cut(spark, d))), show(entity_state_of(spark, d)), ["space", "id", "property", "language"], "v")
    return hexed(out, "id", "property", "language")


# ---- relations -----------------------------------------------------------------------------------------------


@query(f"WITH {_RELATIONS} SELECT id, type, src, dst, created FROM rel")
def relation_create_first_wins(spark, d):
    s = relation_state(spark, d)
    r = s.relations_all.join(s.owners.select("space", "id", F.col("created.block").alias("created")), ["space", "id"])
    return hexed(r.select("id", "type", F.col("from").alias("src"), F.col("to").alias("dst"), "created"), "id", "type", "src", "dst")


@query(f"WITH {_RELATIONS} SELECT id, position, to_version, status FROM rel")
def relation_field_lww(spark, d):
    return hexed(relation_state(spark, d).relations_all.select("id", "position", "to_version", "status"), "id", "to_version")


@query(f"WITH {_RELATIONS} SELECT src, id, position, row_number() OVER (PARTITION BY src ORDER BY position ASC NULLS LAST, id) AS place FROM arel")
def relation_order(spark, d):
    return hexed(V.ordered(relation_state(spark, d).relations, ["from"]).select(F.col("from").alias("src"), "id", "position", F.col("place").cast("long").alias("place")), "src", "id")


@query(f"WITH {_RELATIONS} SELECT id, {sid("encode('" + I.RELATION_ENTITY_PREFIX + "')||unhex(id)")} AS entity FROM rel")
def reified_derivation(spark, d):
    return hexed(relation_state(spark, d).relations_all.select("id", "entity"), "id", "entity")


@query(f"WITH {_RELATIONS} SELECT id, src NOT IN (SELECT {sid("'customer:'||c_custkey")} FROM customer WHERE c_custkey%2=0) AS from_dangling, dst NOT IN (SELECT {sid("'status:'||x")} FROM (VALUES ('F'),('O')) t(x)) AS to_dangling FROM arel")
def dangling_endpoints(spark, d):
    c = L.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lit("main").alias("space"), L.named("customer:", F.col("c_custkey")).alias("id"))
    s = spark.createDataFrame([("F",), ("O",)], "x string").select(F.lit("main").alias("space"), L.named("status:", F.col("x")).alias("id"))
    return hexed(V.dangling(relation_state(spark, d).relations, c.union(s)).select("id", "from_dangling", "to_dangling"), "id")


@query(f"WITH {_RELATIONS} SELECT src, dst, count(*) AS n FROM arel WHERE type={sid("'relation:1-URGENT'")} GROUP BY ALL")
def one_hop(spark, d):
    r = V.one_hop(relation_state(spark, d).relations, L.named("relation:1-URGENT"))
    return hexed(r.groupBy(F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.count("*").alias("n")), "src", "dst")


def _geography(spark, d):
    c, n = L.read(spark, d, "customer"), L.read(spark, d, "nation")
    return c.select(L.named("customer:", F.col("c_custkey")).alias("from"), L.named("nation:", F.col("c_nationkey")).alias("to")), n.select(L.named("nation:", F.col("n_nationkey")).alias("from"), L.named("region:", F.col("n_regionkey")).alias("to"))


@query(f"SELECT {sid("'customer:'||c_custkey")} AS a, {sid("'nation:'||n_nationkey")} AS b, {sid("'region:'||n_regionkey")} AS c FROM customer JOIN nation ON c_nationkey=n_nationkey")
def two_hop(spark, d):
    return hexed(V.two_hop(*_geography(spark, d)), "a", "b", "c")


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT 'supplier:'||s_suppkey AS a, 'nation:'||s_nationkey AS b FROM supplier UNION SELECT 'nation:'||n_nationkey, 'region:'||n_regionkey FROM nation
 UNION SELECT 'nation:'||n_nationkey, 'nation:'||(n_nationkey//2) FROM nation),
r(s,x) AS (SELECT DISTINCT a, a FROM e UNION SELECT s, b FROM r JOIN e ON x=a) SELECT {sid("s")} AS start, {sid("x")} AS id FROM r""")
def reachability(spark, d):
    s, n = L.read(spark, d, "supplier"), L.read(spark, d, "nation")
    edge = lambda df, a, x, b, y: df.select(L.named(a, x).alias("from"), L.named(b, y).alias("to"))
    key = F.col("n_nationkey")
    edges = edge(s, "supplier:", F.col("s_suppkey"), "nation:", F.col("s_nationkey")).union(edge(n, "nation:", key, "region:", F.col("n_regionkey"))).union(edge(n, "nation:", key, "nation:", F.floor(key / 2))).distinct()
    return hexed(V.reachable(edges, edges.select(F.col("from").alias("id")).distinct(), written).select("start", "id"), "start", "id")


@query(f"WITH {_RELATIONS} SELECT {sid("'customer:'||c_custkey")} AS id, EXISTS (SELECT 1 FROM arel r WHERE r.o_custkey=c.c_custkey) AS related FROM customer c")
def exists_semi_anti(spark, d):
    c = L.read(spark, d, "customer").select(L.named("customer:", F.col("c_custkey")).alias("id"))
    some = relation_state(spark, d).relations.select(F.col("from").alias("id")).distinct()
    return hexed(c.join(some.withColumn("related", F.lit(True)), "id", "left").withColumn("related", F.coalesce("related", F.lit(False))), "id")


@query(f"SELECT {sid("'customer:'||c_custkey")} AS id FROM customer WHERE c_mktsegment='BUILDING'")
def types_filter(spark, d):
    c = L.read(spark, d, "customer")
    typed = c.select(L.named("customer:", F.col("c_custkey")).alias("from"), F.unhex(F.lit(I.TYPES)).alias("type"), L.named("segment:", F.col("c_mktsegment")).alias("to"))
    return hexed(V.one_hop(typed, F.unhex(F.lit(I.TYPES)), targets=spark.range(1).select(L.named("segment:BUILDING").alias("id"))).select(F.col("from").alias("id")), "id")


@query(f"WITH {_RELATIONS} SELECT r.id, o_orderstatus AS status_value, o_totalprice AS price FROM arel r JOIN orders o ON o.o_orderkey=r.created")
def reified_qualifiers(spark, d):
    s = relation_state(spark, d)
    o = L.read(spark, d, "orders").select(F.col("o_orderkey").alias("created"), F.col("o_orderstatus").alias("status_value"), F.col("o_totalprice").alias("price"))
    first = s.owners.select("space", "id", F.col("created.block").alias("created"))
    quals = first.join(o, "created").select("space", I.relation_entity_id(F.col("id")).alias("entity"), "status_value", "price")
    return hexed(s.relations.select("space", "id", "entity").join(quals, ["space", "entity"]).select("id", "status_value", "price"), "id")


_ENTITY_OF = sid("encode('" + I.RELATION_ENTITY_PREFIX + "')||unhex(id)")


@query(f"""WITH {_EVENTS}, {_SLOTS}, {_RELATIONS} SELECT space, 'property' AS kind, id AS s, property AS p, coalesce(txt, i64::VARCHAR) AS o FROM live
 UNION ALL SELECT 'main', 'relation', src, type, dst FROM arel UNION ALL SELECT 'main', 'reifies', {_ENTITY_OF}, NULL, id FROM arel
 UNION ALL SELECT 'main', 'subject', {_ENTITY_OF}, NULL, src FROM arel UNION ALL SELECT 'main', 'predicate', {_ENTITY_OF}, NULL, type FROM arel UNION ALL SELECT 'main', 'object', {_ENTITY_OF}, NULL, dst FROM arel""")
def logical_quads(spark, d):
    state = R.State(L.entity_ops(spark, d).unionByName(L.relation_ops(spark, d)))
    return hexed(V.quads(state.values, state.relations, F.coalesce("value.text", F.col("value.i64").cast("string"))), "s", "p")


# ---- pins: what the ends of relations stand for -----------------------------------------------------------------

_PINS = f"""{_EVENTS}, {_SLOTS},
pin AS (SELECT o_orderkey AS k, {sid("'pin:'||o_orderkey")} AS id, CASE WHEN o_orderkey%4=0 THEN 'side' ELSE 'main' END AS space FROM orders),
en AS (
  SELECT k, id, space, 'from' AS "end", {sid("'user:'||(k%300)")} AS target, false AS is_ref, CASE WHEN k%3=0 THEN 'side' ELSE space END AS at_space, CASE WHEN k%35=0 THEN 100000000+k WHEN k%5=0 THEN k%1000 END AS ver FROM pin
  UNION ALL SELECT k, id, space, 'to', CASE WHEN k%2=1 THEN {sid("'vref:'||(k%70)")} ELSE {sid("'user:'||((k*7)%300)")} END, k%2=1, CASE WHEN k%6<2 THEN 'main' ELSE space END, CASE WHEN k%7<3 THEN k%977 END FROM pin),
vr AS (SELECT event_id AS n, CASE WHEN event_id%5=0 THEN 'side' ELSE 'main' END AS space, {sid("'vref:'||(event_id%60)")} AS vid, {sid("'user:'||user_id")} AS entity,
  CASE event_id%3 WHEN 0 THEN {prop("name")} WHEN 1 THEN {prop("score")} ELSE {prop("title")} END AS property, CASE WHEN event_id%3=2 AND event_id%2=0 THEN {lang("de")} END AS language,
  CASE WHEN event_id%4=0 OR event_id%5=0 THEN 'side' ELSE 'main' END AS slot_space FROM events WHERE event_type='view'),
win AS (SELECT space, entity, property, language, slot_space, arg_max(vid, n) AS vid, max(n) AS n FROM vr GROUP BY ALL),
bind AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY space, vid ORDER BY n DESC)=1),
att AS (SELECT en.*, b.entity, b.property, b.language, CASE WHEN is_ref THEN b.slot_space ELSE at_space END AS sp, CASE WHEN is_ref THEN b.entity ELSE target END AS ob,
  ver IS NOT NULL AND e.event_id IS NULL AS unknown, coalesce(ver, 9000000000000) AS upto
  FROM en LEFT JOIN bind b ON is_ref AND b.space=en.at_space AND b.vid=en.target LEFT JOIN events e ON e.event_id=en.ver),
sw AS (SELECT a.id, a."end", arg_max(op, n) AS last FROM att a JOIN ok ON ok.space=a.sp AND ok.id=a.ob AND op IN (3,4) AND n<=upto GROUP BY ALL),
va AS (SELECT a.id, a."end", max(n*2+seq) AS pos FROM att a JOIN ev ON ev.space=a.sp AND ev.id=a.ob AND ev.property=a.property AND n<=upto AND (mode=0 OR ev.language IS NOT DISTINCT FROM a.language) GROUP BY ALL),
vl AS (SELECT a.id, a."end", max(CASE WHEN seq=1 THEN coalesce(txt, i64::VARCHAR) END) AS val FROM att a JOIN va ON va.id=a.id AND va."end"=a."end" JOIN ev ON ev.space=a.sp AND ev.id=a.ob AND ev.property=a.property AND n*2+seq=pos AND (mode=0 OR ev.language IS NOT DISTINCT FROM a.language) GROUP BY ALL),
res AS (SELECT a.*, CASE WHEN unknown THEN 'UNKNOWN_VERSION' WHEN o.id IS NULL OR o.created>upto THEN 'NOT_FOUND' WHEN sw.last=3 THEN 'DELETED' ELSE 'ACTIVE' END AS status, vl.val
  FROM att a LEFT JOIN own o ON o.space=a.sp AND o.id=a.ob LEFT JOIN sw ON sw.id=a.id AND sw."end"=a."end" LEFT JOIN vl ON vl.id=a.id AND vl."end"=a."end")"""


def _endpoints(spark, d, **how):
    log, edits = L.pinned_log(spark, d)
    state = R.State(log)
    return R.resolve_endpoints(state, state.relations.where(F.col("type") == L.named("relation:pins")), R.edit_ends(edits), **how)


@query(f"""WITH {_PINS} SELECT id, "end", target, {sid("'edit:'||ver")} AS version, status FROM res WHERE ver IS NOT NULL AND NOT is_ref""")
def version_pin(spark, d):
    return hexed(_endpoints(spark, d, with_values=False).where("version IS NOT NULL AND NOT is_ref").select("id", "end", "target", "version", "status"), "id", "target", "version")


@query(f"""WITH {_PINS} SELECT id, "end", target, at_space, status FROM res WHERE at_space<>space AND ver IS NULL AND NOT is_ref""")
def space_pin_lookup(spark, d):
    return hexed(_endpoints(spark, d, with_values=False).where("at_space != space AND version IS NULL AND NOT is_ref").select("id", "end", "target", "at_space", "status"), "id", "target")


@query(f"""WITH {_PINS} SELECT id, at_space, target, entity, property, language, status, CASE WHEN status='ACTIVE' THEN val END AS val FROM res WHERE is_ref""")
def value_ref_values(spark, d):
    out = _endpoints(spark, d).where("is_ref").withColumn("val", F.coalesce("value.text", F.col("value.i64").cast("string")))
    return hexed(out.select("id", "at_space", "target", "entity", "property", "language", "status", "val"), "id", "target", "entity", "property", "language")


@query(f"WITH {_EVENTS}, {_SLOTS}, p AS (SELECT *, row_number() OVER (PARTITION BY id,property,language ORDER BY CASE space WHEN 'side' THEN 0 ELSE 1 END) AS r FROM live) SELECT id, property, language, space, txt, i64 FROM p WHERE r=1")
def multi_space_view(spark, d):
    return flat(V.by_space(entity_state_of(spark, d).values, ["side", "main"])).select("id", "property", "language", "space", "txt", "i64")


@query(f"WITH {_EVENTS} SELECT id, count(DISTINCT space) AS spaces, max(n) AS latest FROM ok GROUP BY id")
def space_agreement(spark, d):
    return hexed(entity_state_of(spark, d).accepted.groupBy("id").agg(F.countDistinct("space").alias("spaces"), F.max("ord.block").alias("latest")), "id")


@query(f"WITH {_EVENTS} SELECT id, count(DISTINCT author) AS authors, bool_or(author=3) AS by_third FROM (SELECT id, n%7 AS author FROM ok) GROUP BY id")
def provenance_authors(spark, d):
    edits = L.read(spark, d, "events").select(F.col("event_id").alias("block"), F.array(F.col("event_id") % 7).alias("authors"))
    a = entity_state_of(spark, d).accepted.select("id", F.col("ord.block").alias("block")).join(edits, "block")
    return hexed(a.select("id", F.explode("authors").alias("author")).groupBy("id").agg(F.countDistinct("author").alias("authors"), F.bool_or(F.col("author") == 3).alias("by_third")), "id")


@query(f"""WITH o AS (SELECT CASE WHEN o_orderkey%2=0 THEN 'main' ELSE 'side' END AS space, {sid("'customer:'||o_custkey")} AS root, {sid("'relation:'||o_orderpriority")} AS t, {sid("'relation:clerk'")} AS clerk, o_orderkey AS k FROM orders WHERE o_orderkey%3<>0)
SELECT space, root, CASE k%4 WHEN 0 THEN '' WHEN 1 THEN t ELSE t||'/'||clerk END AS path, count(*) AS n_ops, count(DISTINCT CASE k%4 WHEN 0 THEN 'root' WHEN 1 THEN k::VARCHAR ELSE 'clerk'||(k%10) END) AS n_entities FROM o GROUP BY ALL""")
def context_groups(spark, d):
    x = V.context_groups(L.context_ops(spark, d))
    return x.select("space", I.format_id(F.col("root_id")).alias("root"), F.concat_ws("/", F.transform("path", I.format_id)).alias("path"), "n_ops", "n_entities")


# ---- value refs ----------------------------------------------------------------------------------------------


@query(f"WITH {_REFS} SELECT entity, property, language, ref_id FROM byslot")
def value_ref_slot_lww(spark, d):
    r = R.State(L.value_ref_ops(spark, d)).accepted
    slot = r.select(F.col("value_ref.entity").alias("entity"), F.col("value_ref.property").alias("property"), F.col("value_ref.language").alias("language"), F.col("id").alias("ref_id"), "ord")
    return hexed(slot.groupBy("entity", "property", "language").agg(F.max_by("ref_id", "ord").alias("ref_id")), "entity", "property", "language", "ref_id")


@query(f"WITH {_REFS} SELECT ref_id, arg_max(entity,pos) AS entity, arg_max(property,pos) AS property, arg_max(coalesce(language,'en'),pos) AS language FROM byslot GROUP BY ref_id")
def value_ref_reverse(spark, d):
    v = hexed(R.State(L.value_ref_ops(spark, d)).value_refs.drop("space", "slot_space"), "ref_id", "entity", "property", "language")
    return v.withColumn("language", F.coalesce("language", F.lit("en")))


# ---- checks --------------------------------------------------------------------------------------------------


def _found(ops, check):
    x = K.findings(ops).where(F.col("check") == check)
    return hexed(x.select(F.col("edit_id").alias("edit"), F.col("at").cast("long").alias("at"), "subject"), "edit", "subject")


@query(f"SELECT {sid("'edit:'||(o_custkey%20)")} AS edit, min(o_orderkey) AS at, {sid("'property:'||o_orderpriority")} AS subject FROM orders GROUP BY o_custkey%20, o_orderpriority HAVING count(DISTINCT o_orderkey%2)>1")
def datatype_consistency(spark, d):
    k = F.col("o_orderkey")
    one = F.struct(L.named("property:", F.col("o_orderpriority")).alias("property"), L.value(data_type=F.when(k % 2 == 0, M.INT64).otherwise(M.TEXT), i64=k, text=F.lit("x")).alias("value"))
    return _found(L.edit_ops(L.read(spark, d, "orders"), L.named("edit:", F.col("o_custkey") % 20), k, M.UPDATE_ENTITY, L.named("order:", k), set=F.array(one)), "two types of a property")


@query(f"WITH {_EVENTS}, ok2 AS (SELECT * FROM raw), {_SLOTS.replace('FROM ok WHERE', 'FROM ok2 WHERE')} SELECT {sid("'edit:'||n")} AS edit, id, property FROM ev WHERE seq=1 AND property={prop('score')}")
def schema_type_check(spark, d):
    ops = L.entity_ops(spark, d).withColumns({"edit_id": L.named("edit:", F.col("ord.block")), "op_index": F.col("ord.op_index")})
    schema = spark.range(1).select(F.explode(F.array(*(F.struct(L.named(f"property:{p}").alias("property"), F.lit(M.TEXT).alias("data_type")) for p in ("score", "name")))).alias("x")).select("x.*")
    return hexed(K.schema_findings(ops, schema).select(F.col("edit_id").alias("edit"), "id", "property"), "edit", "id", "property")


def _line_edits(spark, d):
    """lineitem as updates: a line sets its return flag, a text in German where its status is O; lines of one order and a
    third of the suppliers are one op. Odd lines unset instead in set_unset_overlap."""
    x = L.read(spark, d, "lineitem").withColumn("n", F.col("l_linenumber").cast("int"))
    german = F.when(F.col("l_linestatus") == "O", I.language_id(F.lit("de")))
    prop = L.named("property:", F.col("l_returnflag")).alias("property")
    one = F.struct(prop, L.value(data_type=F.lit(M.TEXT), text=F.col("l_linestatus"), language=german).alias("value"))
    mode = F.when(F.col("n") % 3 == 0, M.UNSET_ALL).when(F.col("n") % 3 == 1, M.UNSET_ENGLISH).otherwise(M.UNSET_LANGUAGE)
    off = F.struct(prop, mode.cast("tinyint").alias("mode"), F.when(mode == M.UNSET_LANGUAGE, I.language_id(F.lit("de"))).alias("language"))
    return x, one, off


@query(f"SELECT {sid("'edit:'||l_orderkey")} AS edit, (l_suppkey%3)::BIGINT AS at, {sid("'property:'||l_returnflag")} AS subject FROM lineitem GROUP BY l_orderkey, l_suppkey%3, l_returnflag, l_linestatus='O' HAVING count(*)>1")
def dup_value_check(spark, d):
    x, one, _ = _line_edits(spark, d)
    x = x.groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("g")).agg(F.collect_list(one).alias("sets"))
    return _found(L.edit_ops(x, L.named("edit:", F.col("l_orderkey")), F.col("g"), M.UPDATE_ENTITY, L.named("order:", F.col("l_orderkey")), set=F.col("sets")), "a slot set twice")


@query(f"""SELECT DISTINCT {sid("'edit:'||a.l_orderkey")} AS edit, (a.l_suppkey%3)::BIGINT AS at, {sid("'property:'||a.l_returnflag")} AS subject FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_suppkey%3=b.l_suppkey%3 AND a.l_returnflag=b.l_returnflag
 WHERE a.l_linenumber%2=0 AND b.l_linenumber%2=1 AND CASE b.l_linenumber%3 WHEN 0 THEN true WHEN 1 THEN a.l_linestatus<>'O' ELSE a.l_linestatus='O' END""")
def set_unset_overlap(spark, d):
    x, one, off = _line_edits(spark, d)
    x = x.groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("g")).agg(F.collect_list(F.when(F.col("n") % 2 == 0, one)).alias("sets"), F.collect_list(F.when(F.col("n") % 2 == 1, off)).alias("unsets"))
    return _found(L.edit_ops(x, L.named("edit:", F.col("l_orderkey")), F.col("g"), M.UPDATE_ENTITY, L.named("order:", F.col("l_orderkey")), set=F.col("sets"), unset=F.col("unsets")), "set and unset")


@query(f"""SELECT {sid("'edit:'||o_custkey")} AS edit, max(CASE WHEN o_orderkey%3=1 THEN o_orderkey END) AS at, {sid("'status:'||o_orderstatus")} AS subject FROM orders GROUP BY o_custkey, o_orderstatus
 HAVING min(CASE WHEN o_orderkey%3=0 THEN o_orderkey END)<max(CASE WHEN o_orderkey%3=1 THEN o_orderkey END)""")
def delete_then_create(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, M.DELETE_ENTITY).when(k % 3 == 1, M.CREATE_ENTITY).otherwise(M.UPDATE_ENTITY)
    return _found(L.edit_ops(L.read(spark, d, "orders"), L.named("edit:", F.col("o_custkey")), k, kind, L.named("status:", F.col("o_orderstatus"))), "deleted, then created")


_BOUNDS = "CASE c_custkey%6 WHEN 0 THEN abs(lat)<=90 AND abs(lon)<=180 WHEN 1 THEN abs(lat)<=90 AND abs(lon)<=180 WHEN 2 THEN us BETWEEN 0 AND 86399999999 WHEN 3 THEN abs(off)<=1440 WHEN 4 THEN m%10<>0 OR (m=0 AND e=0) ELSE true END"


@query(f"SELECT {sid("'customer:'||c_custkey")} AS edit, c_custkey AS at, {sid("'property:'||(c_custkey%6)")} AS subject FROM (SELECT c_custkey, (c_custkey*7)%200-100 AS lat, (c_custkey*11)%380-190 AS lon, (c_custkey%100)*1000000000 AS us, c_custkey%3000-1500 AS off, c_custkey%30 AS m, c_custkey%2 AS e FROM customer) WHERE NOT ({_BOUNDS})")
def value_bounds(spark, d):
    k = F.col("c_custkey")
    lat, lon, off, m = ((k * 7) % 200 - 100).cast("double"), ((k * 11) % 380 - 190).cast("double"), (k % 3000 - 1500).cast("smallint"), k % 30
    kinds = [(M.POINT, {"point": F.struct(lat.alias("lat"), lon.alias("lon"), F.lit(None).cast("double").alias("alt"))}), (M.RECT, {"rect": F.struct(lat.alias("min_lat"), lon.alias("min_lon"), F.lit(-80.0).alias("max_lat"), F.lit(10.0).alias("max_lon"))})]
    kinds += [(M.TIME, {"time": F.struct(((k % 100) * 1_000_000_000).cast("long").alias("time_us"), F.lit(0).cast("smallint").alias("offset_min"))}), (M.DATE, {"date": F.struct(F.lit(1).alias("days"), off.alias("offset_min"))})]
    kinds += [(M.DECIMAL, {"dec": F.struct((k % 2).cast("int").alias("exponent"), m.cast("long").alias("mantissa_i64"), F.lit(None).cast("binary").alias("mantissa_big"))}), (M.INT64, {"i64": k})]
    value = L.value(data_type=F.lit(M.INT64), i64=k)
    for i, (kind, given) in enumerate(kinds):
        value = F.when(k % 6 == i, L.value(data_type=F.lit(kind), **given)).otherwise(value)
    sets = F.array(F.struct(L.named("property:", k % 6).alias("property"), value.alias("value")))
    return _found(L.edit_ops(L.read(spark, d, "customer"), L.named("customer:", k), k, M.UPDATE_ENTITY, L.named("customer:", k), set=sets), "value out of bounds")


@query("SELECT o_orderkey, regexp_full_match(o_clerk,'[0-9A-Za-z]{1,64}') AS valid FROM (SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'aV' WHEN 1 THEN '' WHEN 2 THEN 'a-b' ELSE repeat('z',(o_orderkey%130)::INT) END AS o_clerk FROM orders)")
def position_valid(spark, d):
    k = F.col("o_orderkey")
    p = F.when(k % 4 == 0, "aV").when(k % 4 == 1, "").when(k % 4 == 2, "a-b").otherwise(F.expr("repeat('z', cast(o_orderkey % 130 as int))"))
    return L.read(spark, d, "orders").select("o_orderkey", X.position_valid(p).alias("valid"))


# ---- scalar functions ----------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {sid("'order:'||o_orderkey")} AS id FROM orders")
def derived_uuid(spark, d):
    return hexed(L.read(spark, d, "orders").select("o_orderkey", L.named("order:", F.col("o_orderkey")).alias("id")), "id")


@query(f"SELECT o_orderkey, {sid("unhex(" + sid("'customer:'||o_custkey") + ")||unhex(" + sid("'status:'||o_orderstatus") + ")||unhex(" + sid("'relation:'||o_orderpriority") + ")")} AS id FROM orders")
def unique_relation_id(spark, d):
    o = L.read(spark, d, "orders")
    return hexed(o.select("o_orderkey", I.unique_relation_id(L.named("customer:", F.col("o_custkey")), L.named("status:", F.col("o_orderstatus")), L.named("relation:", F.col("o_orderpriority"))).alias("id")), "id")


@query(f"SELECT doc_id, left(sha256(unhex('{I.NAME}')||encode(source)||unhex({lang('de')})),32) AS id, left(sha256(unhex('{I.NAME}')||encode(source)||unhex('{I.NIL}')),32) AS plain FROM documents")
def value_id(spark, d):
    x, name = L.read(spark, d, "documents"), F.unhex(F.lit(I.NAME))
    return hexed(x.select("doc_id", I.text_value_id(name, F.col("source"), I.language_id(F.lit("DE"))).alias("id"), I.text_value_id(name, F.col("source")).alias("plain")), "id", "plain")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN NULL ELSE {sid("'order:'||o_orderkey")} END AS id FROM orders")
def format_parse_id(spark, d):
    k = F.col("o_orderkey")
    text = I.format_id(L.named("order:", k))
    dashed = F.upper(F.concat_ws("-", F.substring(text, 1, 8), F.substring(text, 9, 4), F.substring(text, 13, 4), F.substring(text, 17, 4), F.substring(text, 21, 12)))
    given = F.when(k % 3 == 0, F.concat(text, F.lit("0"))).when(k % 3 == 1, dashed).otherwise(text)
    return hexed(L.read(spark, d, "orders").select("o_orderkey", I.parse_id(given).alias("id")), "id")


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS days, CASE WHEN o_orderkey%2=0 THEN 330 ELSE 0 END AS off, strftime(o_orderdate,'%Y-%m-%d')||CASE WHEN o_orderkey%2=0 THEN '+05:30' ELSE 'Z' END AS written FROM orders")
def date_parse_format(spark, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "+05:30").otherwise(""))
    x = L.read(spark, d, "orders").select("o_orderkey", D.parse_date(text).alias("v"))
    return x.select("o_orderkey", F.col("v.days").alias("days"), F.col("v.offset_min").cast("int").alias("off"), D.format_date(F.col("v")).alias("written"))


_CLOCK = "lpad(((event_id//60)%24)::VARCHAR,2,'0')||':'||lpad((event_id%60)::VARCHAR,2,'0')||':07.'||lpad((event_id%1000)::VARCHAR,3,'0')"


@query(f"SELECT event_id, (((event_id//60)%24)*60+event_id%60)*60000000+7000000+(event_id%1000)*1000 AS us, -480 AS off, CASE WHEN event_id%1000=0 THEN left({_CLOCK},8) ELSE rtrim({_CLOCK},'0') END||'-08:00' AS written, event_id%24>12 AS late FROM events")
def time_parse_format(spark, d):
    n = F.col("event_id")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    text = F.concat(two(F.floor(n / 60) % 24), F.lit(":"), two(n % 60), F.lit(":07."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("-08:00"))
    x = L.read(spark, d, "events").select("event_id", D.parse_time(text).alias("v"))
    return x.select("event_id", F.col("v.time_us").alias("us"), F.col("v.offset_min").cast("int").alias("off"), D.format_time(F.col("v")).alias("written"), (n % 24 > 12).alias("late"))


@query("SELECT event_id, epoch_us(ts)-19800000000 AS epoch, 330 AS off, strftime(ts,'%Y-%m-%dT%H:%M:%S')||CASE WHEN epoch_us(ts)%1000000=0 THEN '' ELSE '.'||rtrim(lpad((epoch_us(ts)%1000000)::VARCHAR,6,'0'),'0') END||'+05:30' AS written FROM events")
def datetime_parse_format(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    x = L.read(spark, d, "events").select("event_id", D.parse_datetime(text).alias("v"))
    return x.select("event_id", F.col("v.epoch_us").alias("epoch"), F.col("v.offset_min").cast("int").alias("off"), D.format_datetime(F.col("v")).alias("written"))


@query("SELECT event_id, row_number() OVER (ORDER BY (event_id%86400)*1000000-((event_id%5)*60)*60000000, event_id%5, event_id) AS place FROM events")
def time_sort(spark, d):
    n = F.col("event_id")
    t = F.struct(((n % 86400) * 1_000_000).alias("time_us"), ((n % 5) * 60).cast("smallint").alias("offset_min"))
    x = L.read(spark, d, "events").select("event_id", D.time_sort_key(t).alias("k"))
    return V.numbered(x, ["k", "event_id"], written).select("event_id", "place")


@query("SELECT event_id, CASE WHEN m=0 THEN e=0 ELSE m%10<>0 END AS normal, CAST(m AS DECIMAL(38,4))/CASE e WHEN 0 THEN 1 WHEN -1 THEN 10 ELSE 100 END = CAST(m AS DOUBLE)/CASE e WHEN 0 THEN 1 WHEN -1 THEN 10 ELSE 100 END AS same, m AS mantissa FROM (SELECT event_id, event_id%500 AS m, -(event_id%3) AS e FROM events)")
def decimal_normalize(spark, d):
    x = L.read(spark, d, "events").selectExpr("event_id", "event_id % 500 AS m", "cast(-(event_id % 3) AS int) AS e")
    dec = X.decimal_value(F.col("e"), F.col("m"))
    return x.select("event_id", X.decimal_normal(F.col("e"), F.col("m")).alias("normal"), (dec.cast("double") == F.col("m") / F.pow(F.lit(10.0), -F.col("e"))).alias("same"), F.col("m").alias("mantissa"))


@query("SELECT c_custkey, abs(c_acctbal/50)<=90 AND abs(c_custkey%400-200)<=180 AS valid FROM customer")
def point_bounds(spark, d):
    return L.read(spark, d, "customer").select("c_custkey", X.point_valid(F.col("c_acctbal") / 50, (F.col("c_custkey") % 400 - 200).cast("double")).alias("valid"))


@query("SELECT c_custkey, lat BETWEEN -40 AND 55 AND lon BETWEEN -20 AND 60 AS plain, lat BETWEEN -40 AND 55 AND (lon>=160 OR lon<=-150) AS across, lon BETWEEN -20 AND 60 AS meets FROM (SELECT c_custkey, c_custkey%180-90 AS lat, c_custkey%360-180 AS lon FROM customer)")
def rect_contains(spark, d):
    x = L.read(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 180 - 90 AS double) AS lat", "cast(c_custkey % 360 - 180 AS double) AS lon")
    rect = lambda a, b, c, e: F.struct(*(F.lit(float(v)).alias(n) for v, n in zip((a, b, c, e), ("min_lat", "min_lon", "max_lat", "max_lon"), strict=True)))
    here = F.struct(F.lit(-90.0).alias("min_lat"), F.col("lon").alias("min_lon"), F.lit(90.0).alias("max_lat"), F.col("lon").alias("max_lon"))
    inside = lambda r: X.rect_contains(r, F.col("lat"), F.col("lon"))
    return x.select("c_custkey", inside(rect(-40, -20, 55, 60)).alias("plain"), inside(rect(-40, 160, 55, -150)).alias("across"), X.rect_intersects(rect(-40, -20, 55, 60), here).alias("meets"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)),6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)) DESC, vec_id LIMIT 20")
def embedding_cosine_topk(spark, d):
    e = L.read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return V.nearest(e.join(F.broadcast(q)), F.col("q"), 20, X.cosine).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT lang, {sid("'" + I.LANGUAGE_PREFIX + "'||lower(lang)")} AS id FROM documents GROUP BY lang")
def language_ids(spark, d):
    return hexed(L.read(spark, d, "documents").select("lang").distinct().withColumn("id", I.language_id(F.upper("lang"))), "id")


@query("SELECT edit, id, dense_rank() OVER (PARTITION BY edit ORDER BY id)-1 AS idx FROM (SELECT DISTINCT o_custkey%50 AS edit, " + sid("'status:'||o_orderpriority") + " AS id FROM orders)")
def dict_intern(spark, d):
    x = L.read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("edit"), L.named("status:", F.col("o_orderpriority")).alias("id")).distinct()
    return hexed(x.withColumn("idx", (F.dense_rank().over(Window.partitionBy("edit").orderBy("id")) - 1).cast("long")), "id")


# ---- the interchange format: encoded and decoded again, so the result equals its source ------------------------


def _heads(ops, name):
    return ops.groupBy("edit_id").agg(F.count("*").cast("int").alias("n_ops")).select("edit_id", F.lit(name).alias("name"), F.array().cast("array<binary>").alias("authors"), F.lit(0).cast("long").alias("created_at"), "n_ops")


def _customer_edits(spark, d, backwards=False, edit=None, **how):
    """Edits of up to a thousand customers each, encoded from columns."""
    from strandlog.sources import edits

    k = F.col("c_custkey")
    sets = F.array(
        F.struct(F.unhex(F.lit(I.NAME)).alias("property"), L.value(data_type=F.lit(M.TEXT), text=F.col("c_name")).alias("value")),
        F.struct(L.named("property:balance").alias("property"), L.value(data_type=F.lit(M.FLOAT64), f64=F.col("c_acctbal"), unit=L.named("unit:dollar")).alias("value")),
    )
    ops = L.edit_ops(L.read(spark, d, "customer"), L.named("edit:", F.floor(k / 1000) if edit is None else edit), k % 1000, M.CREATE_ENTITY, L.named("customer:", k), set=F.reverse(sets) if backwards else sets)
    return edits.encode_edits(edits.gather(ops, _heads(ops, "customers")), **how)


_CUSTOMERS = f"SELECT {sid("'edit:'||(c_custkey//1000)")} AS edit_id, {sid("'customer:'||c_custkey")} AS id, c_name AS name, c_acctbal AS balance FROM customer"


def _decoded(blobs):
    from strandlog.sources import edits

    ops = edits.decode_ops(blobs.select(F.lit("").alias("path"), "content"))
    value = lambda p: F.filter("set", lambda x: x["property"] == p)[0]["value"]
    return hexed(ops.select("edit_id", "id", value(F.unhex(F.lit(I.NAME)))["text"].alias("name"), value(L.named("property:balance"))["f64"].alias("balance")), "edit_id", "id")


@query(_CUSTOMERS)
def wire_roundtrip(spark, d):
    return _decoded(_customer_edits(spark, d))


@query(_CUSTOMERS)
def zstd_roundtrip(spark, d):
    return _decoded(_customer_edits(spark, d, compress=True))


@query(f"SELECT DISTINCT {sid("'edit:'||(c_custkey//1000)")} AS edit_id, true AS same, true AS hash_of_content FROM customer")
def canonical_hash(spark, d):
    """The canonical bytes don't depend on the order in which an op's values come, and their hash is that of the bytes."""
    from strandlog.sources.edits import content_hash

    one, other = (_customer_edits(spark, d, backwards=b) for b in (False, True))
    both = one.select("edit_id", "content").join(other.select("edit_id", F.col("content").alias("again")), "edit_id")
    return hexed(both.select("edit_id", (F.col("content") == F.col("again")).alias("same"), (content_hash(F.col("content")) == F.sha2("again", 256)).alias("hash_of_content")), "edit_id")


@query(_CUSTOMERS)
def fast_roundtrip(spark, d):
    return _decoded(_customer_edits(spark, d, canonical=False))


@query(f"SELECT {sid("'edit:'||k")} AS edit_id, k<1000000 AS compressed, n AS n_ops FROM (SELECT CASE WHEN c_custkey%10=0 THEN 1000000+c_custkey ELSE c_custkey//1000 END AS k, count(*)::INT AS n FROM customer GROUP BY 1)")
def auto_encode(spark, d):
    """Edits of one op stay plain, those of many are compressed; headers are read from either."""
    from strandlog.sources import edits

    k = F.col("c_custkey")
    blobs = written(_customer_edits(spark, d, compress="auto", threshold=600, edit=F.when(k % 10 == 0, k + 1_000_000).otherwise(F.floor(k / 1000))))
    heads = edits.decode_headers(blobs.select(F.lit("").alias("path"), "content")).select("edit_id", "n_ops")
    return hexed(blobs.select("edit_id", edits.is_compressed(F.col("content")).alias("compressed")).join(heads, "edit_id"), "edit_id")


def _mixed_ops(spark, d):
    """customer as ops of all nine types, two of three with a context."""
    c, k = L.read(spark, d, "customer"), F.col("c_custkey")
    kind = (k % 9 + 1).cast("int")
    sets = F.array(F.struct(F.unhex(F.lit(I.NAME)).alias("property"), L.value(data_type=F.lit(M.TEXT), text=F.col("c_name")).alias("value")))
    unsets = F.array(F.struct(L.named("property:old").alias("property"), F.lit(M.UNSET_ALL).cast("tinyint").alias("mode"), F.lit(None).cast("binary").alias("language")))
    ends = L._relation(L.named("relation:in"), L.named("customer:", k), L.named("nation:", F.col("c_nationkey")), F.concat(F.lit("p"), (k % 7).cast("string")), to_version=F.when(k % 2 == 0, L.named("edit:", k)), from_space=F.when(k % 4 == 0, L.named("space:side")))
    moved = L._relation(position=F.concat(F.lit("q"), (k % 5).cast("string")))
    ref = F.struct(L.named("customer:", k).alias("entity"), F.unhex(F.lit(I.NAME)).alias("property"), F.when(k % 2 == 0, I.language_id(F.lit("de"))).alias("language"), F.when(k % 4 == 0, L.named("space:side")).alias("space"))
    edge = F.struct(L.named("relation:in").alias("type_id"), L.named("customer:", k).alias("to_entity_id"))
    context = F.when((k % 3 != 0) & (kind != M.CREATE_VALUE_REF), F.struct(L.named("nation:", F.col("c_nationkey")).alias("root_id"), F.array(edge).alias("edges")))
    given = {"set": F.when(kind <= M.UPDATE_ENTITY, sets), "unset": F.when(kind == M.UPDATE_ENTITY, unsets), "relation": F.when(kind == M.CREATE_RELATION, ends).when(kind == M.UPDATE_RELATION, moved), "unset_fields": F.when(kind == M.UPDATE_RELATION, 8), "value_ref": F.when(kind == M.CREATE_VALUE_REF, ref), "context": context}
    return L.edit_ops(c, L.named("edit:", F.floor(k / 500)), k % 500, kind, L.named("thing:", k), **given)


@query(f"""SELECT {sid("'edit:'||(c_custkey//500)")} AS edit_id, (c_custkey%9+1)::INT AS op_type, {sid("'thing:'||c_custkey")} AS id, CASE c_custkey%9+1 WHEN 1 THEN c_name WHEN 2 THEN c_name||'-'||{prop("old")} WHEN 5 THEN {sid("'nation:'||c_nationkey")}||'p'||(c_custkey%7) WHEN 6 THEN 'q'||(c_custkey%5)||'8' WHEN 9 THEN {sid("'customer:'||c_custkey")} END AS said,
 CASE WHEN c_custkey%9+1=5 AND c_custkey%2=0 THEN {sid("'edit:'||c_custkey")} WHEN c_custkey%9+1=9 AND c_custkey%2=0 THEN {lang("de")} END AS pin, CASE WHEN c_custkey%9+1 IN (5,9) AND c_custkey%4=0 THEN {sid("'space:side'")} END AS pin_space,
 CASE WHEN c_custkey%3<>0 AND c_custkey%9+1<>9 THEN {sid("'nation:'||c_nationkey")} END AS root, CASE WHEN c_custkey%3<>0 AND c_custkey%9+1<>9 THEN {sid("'customer:'||c_custkey")} END AS leaf FROM customer""")
def all_ops_roundtrip(spark, d):
    """Ops of all types, with pins and contexts, written in the format and read again."""
    from strandlog.sources import edits

    ops = _mixed_ops(spark, d)
    blobs = edits.encode_edits(edits.gather(ops, _heads(ops, "mixed")))
    x = edits.decode_ops(blobs.select(F.lit("").alias("path"), "content"))
    kind, text = F.col("op_type"), F.get("set", F.lit(0))["value"]["text"]
    said = (
        F.when(kind == 1, text).when(kind == 2, F.concat(text, F.lit("-"), I.format_id(F.get("unset", F.lit(0))["property"]))).when(kind == 5, F.concat(I.format_id(F.col("relation.to")), F.col("relation.position")))
        .when(kind == 6, F.concat(F.col("relation.position"), F.col("unset_fields").cast("string"))).when(kind == 9, I.format_id(F.col("value_ref.entity")))
    )
    pin = F.coalesce(F.col("relation.to_version"), F.col("value_ref.language"))
    out = x.select("edit_id", kind.cast("int").alias("op_type"), "id", said.alias("said"), pin.alias("pin"), F.coalesce(F.col("relation.from_space"), F.col("value_ref.space")).alias("pin_space"), F.col("context.root_id").alias("root"), F.get("context.edges", F.lit(0))["to_entity_id"].alias("leaf"))
    return hexed(out, "edit_id", "id", "pin", "pin_space", "root", "leaf")


@query("SELECT n_nationkey, chr((97+n_nationkey%25)::INT) AS low, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', ((36+n_nationkey%25+61+1)//2)::INT+1, 1) AS position FROM nation")
def midpoint_positions(spark, d):
    x = L.read(spark, d, "nation").select("n_nationkey", F.char(F.lit(97) + F.col("n_nationkey") % 25).alias("low"))
    return x.withColumn("position", X.midpoints("low", F.lit("zzzz")))


@query(f"SELECT DISTINCT c_mktsegment AS name, {sid("'" + I.GENESIS_PREFIX + "'||c_mktsegment")} AS id, {sid("'" + I.DATA_TYPE_PREFIX + "'||lower(c_mktsegment)")} AS type_id FROM customer")
def genesis_ids(spark, d):
    x = L.read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return hexed(x.select("name", I.genesis_id(F.col("name")).alias("id"), I.data_type_id(F.col("name")).alias("type_id")), "id", "type_id")


@query("SELECT event_id, event_id%3<>0 AS valid FROM events")
def schedule_valid(spark, d):
    n = F.col("event_id")
    rule = F.when(n % 3 == 0, "BYDAY=MO").when(n % 3 == 1, "FREQ=WEEKLY;BYDAY=MO,FR").otherwise("RRULE:FREQ=DAILY;COUNT=9")
    return L.read(spark, d, "events").select("event_id", X.schedule_valid(rule).alias("valid"))


@query("SELECT c_custkey, list_transform(range(8), lambda i: (c_custkey//(1<<i))%2)::VARCHAR AS bits FROM customer")
def embedding_unpack(spark, d):
    data = F.unhex(F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"))
    bits = X.embedding_unpack(F.lit(2), F.lit(8), data)
    return L.read(spark, d, "customer").select("c_custkey", F.concat(F.lit("["), F.concat_ws(", ", F.transform(bits, lambda b: b.cast("int").cast("string"))), F.lit("]")).alias("bits"))
