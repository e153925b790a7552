"""Runs scanned end to end: landed pages of three runs, made of the given parts, to log, state, ledger and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import Tables
from checks.registry import register
from checks.text_queries import items_1, items_2, items_3
from sightline.operators import ledger as G
from sightline.operators.filters import Filters
from sightline.plans import scan as S
from sightline.session import new_path, shuffled
from sightline.sources import landed

SITES = ("midland", "hkp", "centanet", "ricacorp")
PAGE = 20
SCOPE = S.Scope(Filters(min_rent=9200), page_size=PAGE)
RUNS = [
    S.Run(r, f"2024-03-0{r} 06:00:00", "initial" if r == 1 else "daily", SITES, ("centanet",) if r == 3 else ()) for r in range(1, 4)
]
_DONE: dict[tuple[str, str], str] = {}


def landing(t: Tables) -> DataFrame:
    """Pages of three runs. Every sixth record is away in a run; run 2 has a broken and a lost page, run 3 an empty and a retried one."""
    family = {"midland": (landed.RESULT, items_1), "hkp": (landed.RESULT, items_1), "centanet": (landed.DATA, items_3), "ricacorp": (landed.STATE, items_2)}
    out = None
    for site, (kind, items) in family.items():
        own = items(t, site)
        runs = own.withColumn("run_id", F.explode(F.array(*[F.lit(r.run_id) for r in RUNS]))).where((F.col("id") + F.col("run_id")) % 6 != 0)
        page = runs.withColumn("page", F.floor(F.col("id") / (4 * PAGE)) + 1).groupBy("run_id", "page").agg(F.sort_array(F.collect_list("item")).alias("items"))
        last = page.groupBy("run_id").agg(F.max("page").alias("last"))
        page = page.join(F.broadcast(last), "run_id").withColumn("source_site", F.lit(site))
        rows = F.when((F.col("run_id") == 3) & (F.lit(site) == "ricacorp") & (F.col("page") == 2), F.slice("items", 1, 0)).otherwise(F.col("items"))
        if kind == landed.STATE:
            state = F.to_json(F.struct(rows.alias("POSTS"), F.col("last").alias("POSTSNUMPAGES"), (F.col("last") * PAGE).alias("POSTSTOTAL")))
            for a, b in (("&", "&a;"), ('"', "&q;"), ("<", "&l;"), (">", "&g;")):
                state = F.replace(state, F.lit(a), F.lit(b))
            body = F.concat(F.lit('<script id="serverApp-state" type="application/json">'), state, F.lit("</script>"))
        else:
            body = F.to_json(F.struct((F.col("last") * PAGE).alias("count"), rows.alias(kind)))
        broken = (F.col("run_id") == 2) & (F.lit(site) == "midland") & (F.col("page") == 1)
        body = F.when(broken, F.left(body, F.length(body) - 5)).otherwise(body)
        page = page.where(~((F.col("run_id") == 2) & (F.lit(site) == "hkp") & (F.col("page") == F.col("last"))))
        page = page.select("run_id", "source_site", F.lit(kind).alias("family"), "page", F.lit("u").alias("source_url"), F.lit(None).cast("string").alias("error"), body.alias("body"))
        retried = page.where("run_id = 3 AND source_site = 'midland' AND page = 1").withColumns({"error": F.lit("timed out"), "body": F.lit(None).cast("string")})
        page = page.unionByName(retried)
        out = page if out is None else out.unionByName(page)
    return out


def scanned(t: Tables) -> str:
    """Folder of the finished runs; the second is asked for again, which must change nothing."""
    at = (t.spark.sparkContext.applicationId, t.dir)
    if at not in _DONE:
        path, folder = new_path(t.spark, "landing"), new_path(t.spark, "scan")
        landing(t).write.partitionBy("run_id").parquet(path)
        pages = landed.read_landing(t.spark, path)
        for run in RUNS:
            S.scan(t.spark, pages, run, SCOPE, folder)
        if S.scan(t.spark, pages, RUNS[1], SCOPE, folder):
            raise AssertionError("a finished run was scanned again")
        _DONE[at] = folder
    return _DONE[at]


def _state(t: Tables) -> DataFrame:
    folder = scanned(t)
    log = S.read(t.spark, folder, "observations").groupBy("source_key").agg(
        F.count("*").alias("observations"), F.countDistinct("obs_id").alias("ids"), F.max("rent_hkd").alias("rent_hkd"))
    state = S.read(t.spark, folder, "state").drop("listing_id", "source_url", "source_listing_id")
    return state.join(shuffled(log), "source_key")


_BASE = f"""WITH r AS (SELECT unnest(range(1, 4)) AS run_id), p AS (
  SELECT run_id, site AS source_site, site || ':' || num AS source_key, id // {4 * PAGE} + 1 AS page, rent FROM props, r WHERE (id + run_id) % 6 <> 0
), due AS (SELECT run_id, source_site, max(page) AS last FROM p GROUP BY ALL
), pg AS (
  SELECT DISTINCT p.run_id, p.source_site, p.page, due.last,
    CASE WHEN p.run_id = 2 AND p.source_site = 'midland' AND p.page = 1 THEN 'unreadable' WHEN p.run_id = 3 AND p.source_site = 'ricacorp' AND p.page = 2 THEN 'no rows' END AS problem
  FROM p JOIN due USING (run_id, source_site)
  WHERE NOT (p.run_id = 2 AND p.source_site = 'hkp' AND p.page = due.last) AND NOT (p.run_id = 3 AND p.source_site = 'centanet')
), raw AS (SELECT p.* FROM p JOIN pg USING (run_id, source_site, page) WHERE pg.problem IS NULL
), n AS (SELECT run_id, source_site, count(*) AS raw, count(*) FILTER (WHERE coalesce(rent >= 9200, true)) AS kept FROM raw GROUP BY ALL
), c AS (
  SELECT run_id, source_site, max(CASE WHEN problem IS DISTINCT FROM 'unreadable' THEN last END) AS declared, count(*) FILTER (WHERE problem IS NULL) AS seen, count(problem) AS broken FROM pg GROUP BY ALL
), led AS (
  SELECT r.run_id, s.source_site, NOT (r.run_id = 3 AND s.source_site = 'centanet') AS allowed, coalesce(c.seen, 0) AS pages_seen, coalesce(c.broken, 0) AS broken,
    CASE WHEN r.run_id = 3 AND s.source_site = 'centanet' THEN 0 ELSE greatest(1, coalesce(c.declared, 1)) END AS pages_due, coalesce(n.raw, 0) AS raw, coalesce(n.kept, 0) AS kept
  FROM r CROSS JOIN (SELECT unnest(['midland', 'hkp', 'centanet', 'ricacorp']) AS source_site) s LEFT JOIN c USING (run_id, source_site) LEFT JOIN n USING (run_id, source_site)
), led2 AS (SELECT *, broken + greatest(0, pages_due - pages_seen - broken) + CASE WHEN allowed THEN 0 ELSE 1 END AS errors FROM led
), gate AS (SELECT *, allowed AND (errors = 0 OR raw > 0) AS ok, allowed AND run_id > 1 AND errors = 0 AND kept >= 1 AS eligible FROM led2
), seen AS (SELECT DISTINCT source_key, source_site, run_id FROM raw WHERE coalesce(rent >= 9200, true)
), nx AS (SELECT *, lead(run_id) OVER (PARTITION BY source_key ORDER BY run_id) AS next_run,
    (SELECT min(g.run_id) FROM gate g WHERE g.source_site = seen.source_site AND g.run_id > seen.run_id AND g.eligible) AS next_gate FROM seen
), ev AS (SELECT *, CASE WHEN next_gate IS NOT NULL AND (next_run IS NULL OR next_gate < next_run) THEN next_gate END AS missing FROM nx)"""


def scan_oracle(select: str) -> str:
    from checks.oracle import sql

    text = sql("SELECT * FROM props")
    head = text[: text.rindex("SELECT * FROM props")].rstrip()
    return f"{head}, {_BASE.removeprefix('WITH ')} {select}"


_DAY = "'2024-03-0' || {} || ' 06:00:00'"
register("scan_end_to_end", _state, scan_oracle(f"""SELECT source_key, any_value(source_site) AS source_site, {_DAY.format('min(ev.run_id)')} AS first_seen_at, {_DAY.format('max(ev.run_id)')} AS last_seen_at,
    {_DAY.format('min(missing)')} AS first_missing_at, count(missing) AS missing_count, arg_max(missing IS NULL, ev.run_id) AS active, CAST(max(ev.run_id) AS INT) AS last_run_id,
    count(*) AS observations, count(*) AS ids, any_value(rent) AS rent_hkd FROM ev JOIN (SELECT DISTINCT source_key, rent FROM p) USING (source_key) GROUP BY source_key"""))
register("g20_source_ledger", lambda t: S.validation(t.spark, scanned(t)),
         scan_oracle("""SELECT run_id, source_site, ok, errors, pages_due, pages_seen, raw AS raw_observations, kept AS filtered_observations, raw - kept AS rejected_observations,
    eligible AS missing_marking_enabled, coalesce(m.n, 0) AS missing_sources_marked FROM gate LEFT JOIN (SELECT missing AS run_id, source_site, count(*) AS n FROM ev WHERE missing IS NOT NULL GROUP BY ALL) m USING (run_id, source_site)"""))
register("k4_derived_gate", lambda t: S.read(t.spark, scanned(t), "ledger").select("run_id", "source_site", "errors", "ok", "eligible"),
         scan_oracle("SELECT run_id, source_site, errors, ok, eligible FROM gate"))
register("k9_derived_status", lambda t: S.manifests(t.spark, scanned(t)).select("run_id", "mode", "status", "errors", "inserted", "missing_marked"),
         scan_oracle("""SELECT CAST(run_id AS INT) AS run_id, CASE WHEN run_id = 1 THEN 'initial' ELSE 'daily' END AS mode, CASE WHEN sum(errors) > 0 THEN 'partial' ELSE 'ok' END AS status, CAST(sum(errors) AS BIGINT) AS errors,
    CAST(sum(kept) AS BIGINT) AS inserted, (SELECT count(*) FROM ev WHERE missing = gate.run_id) AS missing_marked FROM gate GROUP BY run_id"""))
register("a5_declared_pages", lambda t: G.completeness(S.read(t.spark, scanned(t), "facts")),
         scan_oracle("""SELECT run_id, source_site, greatest(1, coalesce(declared, 1)) AS pages_due, seen AS pages_seen, broken AS pages_broken, greatest(0, greatest(1, coalesce(declared, 1)) - seen - broken) AS pages_lost,
    seen >= greatest(1, coalesce(declared, 1)) AS complete FROM c"""))
register("a5_page_problems", lambda t: G.problem_counts(S.read(t.spark, scanned(t), "facts"), S.read(t.spark, scanned(t), "ledger")),
         scan_oracle("""SELECT run_id, source_site, problem, count(*) AS pages FROM pg WHERE problem IS NOT NULL GROUP BY ALL
    UNION ALL SELECT run_id, source_site, 'lost', pages_due - pages_seen - broken FROM led WHERE pages_due > pages_seen + broken
    UNION ALL SELECT run_id, source_site, 'source not allowed', 1 FROM led WHERE NOT allowed"""))
