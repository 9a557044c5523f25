"""Package discovery and project values on an object-based network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S

#: Packages of the network itself.  Fixed values.
SYSTEM_PACKAGES = ["0x" + "0" * 63 + d for d in "0123"]

OBJECT_CHANGES = "array<struct<type:string,packageId:string,package:string,objectId:string,objectType:string,owner:map<string,string>>>"


_COMMANDS = "transaction:struct<data:struct<transaction:struct<transactions:array<map<string,string>>>>>"
_BODY = f"{_COMMANDS},objectChanges:{OBJECT_CHANGES}"
#: A raw transaction, with its parts under result or at the top.
PAYLOAD = f"struct<result:struct<{_BODY}>,{_BODY}>"


def raw_facts(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """raw with calls, published and objects of each raw transaction in JSON; bad parts are left out.

    A payload is parsed once, with owners as maps; each step of what follows is an array of its own, so
    that no id is normalized twice.
    """
    path = "transaction.data.transaction.transactions"
    rows = raw.withColumn("__p", F.from_json(payload, PAYLOAD)).select(
        *raw.columns, F.coalesce(f"__p.result.{path}", f"__p.{path}").alias("__commands"),
        F.coalesce("__p.result.objectChanges", "__p.objectChanges", F.expr(f"cast(array() as {OBJECT_CHANGES})")).alias("__changes"),
    )
    own = lambda x: x.isNotNull() & ~x.isin(*SYSTEM_PACKAGES)
    ids = lambda texts: F.sort_array(F.array_distinct(F.filter(F.transform(texts, S.sui_id), own)))
    moves = F.transform("__commands", lambda c: F.coalesce(F.try_element_at(c, F.lit("MoveCall")), F.try_element_at(c, F.lit("moveCall"))))
    calls = F.coalesce(ids(F.transform(moves, lambda m: F.get_json_object(m, "$.package"))), F.array().cast("array<string>"))
    made = F.filter("__changes", lambda c: F.lower(c["type"]) == "published")
    published = ids(F.transform(made, lambda c: F.coalesce(c["packageId"], c["package"], c["objectId"])))

    def seen(c: Column) -> Column:
        parent = F.coalesce(*(F.nullif(F.try_element_at(c["owner"], F.lit(k)), F.lit("")) for k in ("ObjectOwner", "objectOwner", "object_owner")))
        shared = F.try_element_at(c["owner"], F.lit("Shared")).isNotNull()
        return F.struct(c["objectType"].alias("object_type"), c["objectId"].alias("object"), shared.alias("shared"), F.when(~F.coalesce(shared, F.lit(False)), parent).alias("parent"))

    def state(x: Column) -> Column:
        kind = F.when(x["shared"], "shared").when(x["parent"].isNotNull(), "object")
        return F.struct(S.sui_id(F.substring_index(x["object_type"], "::", 1)).alias("package_id"), S.sui_id(x["object"]).alias("object_id"), x["object_type"].alias("object_type"), kind.alias("owner_kind"), S.sui_id(x["parent"]).alias("parent_object"))

    others = F.filter("__changes", lambda c: (F.lower(F.coalesce(c["type"], F.lit(""))) != "published") & c["objectType"].contains("::"))
    owned = F.filter(F.transform(others, seen), lambda x: x["shared"] | x["parent"].isNotNull())
    objects = F.filter(F.transform(owned, state), lambda o: own(o["package_id"]) & o["object_id"].isNotNull())
    return rows.withColumns({"calls": calls, "published": published, "objects": objects}).drop("__commands", "__changes")


def package_metadata(tx: DataFrame) -> DataFrame:
    """Packages of indexed transactions: a row a package and transaction."""
    m = tx.where("lower(txStatus) = 'success'").select("digest", "checkpoint", F.explode("packagesMetadata").alias("m"))
    return m.select("digest", "checkpoint", S.sui_id(F.col("m.packageId")).alias("package_id"), F.col("m.name").alias("name")).where("package_id is not null")


def lineage(packages: DataFrame) -> DataFrame:
    """The least of a project's package ids stands for all its versions."""
    return packages.withColumn("lineage", F.array_min(F.transform("project_packages", S.sui_id)))


def package_list(c: Column) -> Column:
    """Normalized, sorted, distinct packages of a list of ids, or of objects in JSON that hold one; bad ids are left out."""
    own = lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.coalesce(*(F.get_json_object(x, f"$.{k}") for k in ("packageAddress", "packageId", "address")))).otherwise(x)
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: S.sui_id(own(x))), lambda x: x.isNotNull())))


def _given(v: Column, path: str) -> Column:
    """What a variant has under path; null also where it is JSON's null."""
    own = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(own), own)


def result_items(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """raw with item, a VARIANT: a row an object in the list of a provider's answer.

    The list is the document itself or what it has under content, value or data, the first that is not
    null; where that is an object, what this has under content, value or items.  Entries of a list that
    are no objects are left out; an empty list gives no rows.  An answer without a list, or one that is
    no JSON, gives one row with error set.  A payload is parsed once, whatever its shape.
    """
    rows = raw.withColumn("__v", F.try_parse_json(payload))
    rows = rows.withColumn("__top", F.coalesce(*(_given(F.col("__v"), f"$.{k}") for k in ("content", "value", "data"))))
    inner = F.coalesce(*(_given(F.col("__top"), f"$.{k}") for k in ("content", "value", "items")))
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    # the row number keeps the optimizer from writing the search again for each use of the list
    rows = rows.withColumn("__l", F.coalesce(as_list(F.col("__v")), as_list(F.col("__top")), as_list(inner))).withColumn("__row", F.monotonically_increasing_id())
    objects = F.filter("__l", lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
    none = F.array(F.lit(None).cast("variant"))
    rows = rows.where("__row >= 0").select(*raw.columns, F.col("__l").isNull().alias("error"), F.when(F.col("__l").isNull(), none).otherwise(objects).alias("__l"))
    return rows.select(*raw.columns, "error", F.explode("__l").alias("item"))


def item_field(item: Column, *names: str, kind: str = "string") -> Column:
    """The first of several fields that an item has, as a type; null where it can't be."""
    return F.coalesce(*(F.try_variant_get(item, f"$.{n}", kind) for n in names))


def project_snapshot(projects: DataFrame, policies: DataFrame, min_usd: float, anomaly_usd: float) -> DataFrame:
    """(project_key, indexed_tvl, packages, status, valuation) of provider rows with alias fields."""
    tvl = F.coalesce("currTvl", "currentTvl", "tvl").try_cast("double")
    rows = projects.withColumn("project_key", F.lower(F.trim("projectName"))).withColumn("packages", package_list(F.when(F.size("packages") > 0, F.col("packages")).otherwise(F.col("projectPackages")))).join(policies, "project_key", "left")
    judged = S.project_status(tvl, F.col("packages"), F.col("policy"), min_usd, anomaly_usd)
    return rows.select("project_key", F.when(S.finite(tvl), tvl).alias("indexed_tvl"), "packages", judged["status"].alias("status"), judged["valuation"].alias("valuation"))


def pool_projects(pools: DataFrame, projects: DataFrame) -> DataFrame:
    """The project of each pool: by its key, else by name, else the key or name that it gives."""
    key = F.lower(F.trim(F.coalesce("projectId", F.lit(""))))
    names = [c for c in ("projectName", "dexName") if c in pools.columns]
    name = F.trim(F.coalesce(*names, F.lit("")))
    rows = pools.withColumn("__k", key).withColumn("__n", F.lower(name))
    by_key = projects.select(F.col("project_key").alias("__k"), F.col("project_key").alias("k1")).distinct()
    by_name = projects.groupBy(F.lower(F.trim("project_name")).alias("__n")).agg(F.max("project_key").alias("k2"))
    out = rows.join(by_key, "__k", "left").join(by_name, "__n", "left")
    none = lambda c: F.when(c != "", c)
    return out.withColumn("project_key", F.coalesce("k1", "k2", none(F.col("__k")), none(F.col("__n")))).drop("__k", "__n", "k1", "k2")


def project_pools(projects: DataFrame, pools: DataFrame) -> DataFrame:
    """Projects with pool evidence; verified pools are never added to the indexed value."""
    own = pools.groupBy("project_key").agg(
        F.coalesce(F.sum(F.when(F.col("object_exists") == 1, F.col("liquidity_usd"))), F.lit(0.0)).alias("verified_pool_tvl"),
        F.count("*").alias("pool_count"),
        F.count_if(F.col("object_exists") == 1).alias("verified_pool_count"),
    )
    return projects.join(own, "project_key", "left").fillna(0, ["verified_pool_tvl", "pool_count", "verified_pool_count"])


def owners(packages: DataFrame, objects: DataFrame) -> DataFrame:
    """Each package with itself and its active objects as owners of balances."""
    o = objects.where("active = 1").groupBy("package_id").agg(F.array_sort(F.collect_set("object_id")).alias("o"))
    out = packages.join(o, "package_id", "left")
    return out.select("package_id", F.array_distinct(F.concat(F.array("package_id"), F.coalesce("o", F.array().cast("array<string>")))).alias("owners"))


def balance_items(rows: DataFrame) -> DataFrame:
    """Positive balances only; priced if a value in dollars is there."""
    amount, usd = S.nonneg(F.col("balance")), S.nonneg(F.col("balanceUsd"))
    return rows.withColumn("amount", amount).withColumn("usd_value", usd).withColumn("priced", usd.isNotNull()).where(amount > 0)


def stale_packages(packages: DataFrame, scans: DataFrame, cutoff: str) -> DataFrame:
    """Packages without a scan since cutoff."""
    last = scans.groupBy("package_id").agg(F.max("scanned_at").alias("scanned_at"))
    return packages.join(last, "package_id", "left").where(F.col("scanned_at").isNull() | (F.col("scanned_at") < F.lit(cutoff).cast("timestamp")))


def top_pools(pools: DataFrame, min_liquidity: float, limit: int) -> DataFrame:
    return pools.where(F.col("liquidity_usd") >= min_liquidity).orderBy(F.desc("liquidity_usd"), "pool_id").limit(limit)


def verify_checkpoints(frames: DataFrame) -> DataFrame:
    """(range_start, range_end, state, resume_cursor) from the frames of each range, in page and frame order.

    frames: (range_start, range_end, page, frame, digest, checkpoint, cursor, end_reason).  Only reason 3
    verifies a range; 1 and 2 resume from the terminal cursor.  A page without a terminal frame, a frame
    after it, a missing or repeated cursor, or a transaction outside the range is an error.
    """
    key = ["range_start", "range_end"]
    page = [*key, "page"]
    w = Window.partitionBy(*page)
    f = frames.withColumn("__last", F.max("frame").over(w)).withColumn("__end", F.col("end_reason").isNotNull())
    bad = (F.coalesce("cursor", F.lit("")) == "") | (F.col("digest").isNotNull() & (F.col("checkpoint").isNull() | (F.col("checkpoint") < F.col("range_start")) | (F.col("checkpoint") >= F.col("range_end")))) | (F.col("__end") & (F.col("frame") != F.col("__last")))
    pages = f.groupBy(*page).agg(
        F.max(bad.cast("int")).alias("bad"),
        F.max(F.when(F.col("__end"), F.col("end_reason"))).alias("reason"),
        F.max(F.when(F.col("__end"), F.col("cursor"))).alias("cursor"),
    )
    o = Window.partitionBy(*key).orderBy("page")
    seen = Window.partitionBy(*key, "cursor")
    # a page that only repeats the cursor where the final page ended is no repeat of its own
    pages = pages.withColumn("again", F.count(F.when(F.col("reason") != 3, 1)).over(seen) > 1).withColumn("last", F.lead("page").over(o).isNull())
    wrong = (F.col("bad") == 1) | F.col("reason").isNull() | ~F.col("reason").isin(1, 2, 3) | (F.col("reason").isin(1, 2) & F.col("again")) | ((F.col("reason") == 3) & ~F.col("last"))
    out = pages.groupBy(*key).agg(F.max(wrong.cast("int")).alias("wrong"), F.max_by("reason", "page").alias("reason"), F.max_by("cursor", "page").alias("cursor"))
    state = F.when(F.col("wrong") == 1, "error").when(F.col("reason") == 3, "verified").otherwise("resume")
    return out.select(*key, state.alias("state"), F.when(state == "resume", F.col("cursor")).alias("resume_cursor"))


def paged_window(pages: DataFrame, key: list[str]) -> DataFrame:
    """Whether a paged read has a gap: neither the cutoff nor a seen digest was reached; the greatest checkpoint stays."""
    out = pages.groupBy(*key).agg(F.bool_or(F.col("reached_cutoff") | F.col("seen_digest")).alias("__ok"), F.max("checkpoint").alias("checkpoint"))
    return out.select(*key, (~F.col("__ok")).alias("coverage_gap"), "checkpoint")


def sync_projects(stored: DataFrame, snapshot: DataFrame, as_of: str) -> DataFrame:
    """Stored projects (project_key, indexed_tvl, packages, status, valuation, complete, seen_at) after a provider's snapshot.

    Projects in it are replaced, those that it lacks stay but are no longer complete.  An empty
    snapshot, as of a provider that is out, changes nothing.
    """
    new = snapshot.select("project_key", "indexed_tvl", "packages", "status", "valuation", F.lit(True).alias("complete"), F.lit(as_of).cast("timestamp").alias("seen_at"))
    gone = stored.join(new.select("project_key"), "project_key", "left_anti")
    any_row = new.agg((F.count("*") > 0).alias("__any"))
    gone = gone.crossJoin(any_row).withColumn("complete", F.col("complete") & ~F.col("__any")).drop("__any")  # one row
    return gone.select(*new.columns).unionByName(new)


def package_projects(stored: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(package_id, project_key): the mapping of the projects in the snapshot replaces theirs of before; others keep theirs."""
    new = snapshot.select(F.explode("packages").alias("package_id"), "project_key").distinct()
    return stored.join(snapshot.select("project_key"), "project_key", "left_anti").select("package_id", "project_key").unionByName(new)


def quarantine_projects(stored: DataFrame, policies: DataFrame, anomaly_usd: float) -> DataFrame:
    """Stored projects whose value is out of bounds become incomplete, unless a policy vouches for them; doing it again changes nothing."""
    rows = stored.join(policies, "project_key", "left")
    out = F.coalesce(F.col("indexed_tvl") >= anomaly_usd, F.lit(False)) & ~F.col("policy").eqNullSafe(F.lit("include_verified"))
    return rows.withColumn("status", F.when(out, "incomplete").otherwise(F.col("status"))).withColumn("valuation", F.when(out, "anomalous_balance").otherwise(F.col("valuation"))).drop("policy")


def pool_summary(pools: DataFrame) -> DataFrame:
    return pools.agg(F.count("*").alias("pools"), F.count_if(F.col("object_exists") == 1).alias("verified"), F.count("project_key").alias("with_project"), F.coalesce(F.sum("liquidity_usd"), F.lit(0.0)).alias("liquidity_usd"))


def status_summary(projects: DataFrame, as_of: str, since: str, min_usd: float) -> DataFrame:
    """Projects by the status they have now, old data counting as incomplete, and how many are new since a time."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("seen_at")
    now = S.current_project_status(F.col("status"), F.col("complete"), F.size("packages"), age, F.col("indexed_tvl"), min_usd)
    rows = projects.withColumn("now", now)
    return rows.groupBy("now").agg(F.count("*").alias("projects"), F.count_if(F.col("first_seen") >= F.lit(since).cast("timestamp")).alias("new"), F.coalesce(F.sum("indexed_tvl"), F.lit(0.0)).alias("indexed_tvl"))


def project_report(projects: DataFrame, pools: DataFrame) -> DataFrame:
    """Projects with their pools' evidence and their packages as text, the most valuable first."""
    rows = project_pools(projects, pools).withColumn("packages_text", F.array_join("packages", ", "))
    return rows.orderBy(F.desc_nulls_last("indexed_tvl"), "project_key")


def package_report(mapping: DataFrame, scans: DataFrame) -> DataFrame:
    """Packages with their project and their latest scan."""
    last = scans.groupBy("package_id").agg(F.max_by(F.struct("scanned_at", "total_usd", "status"), "scanned_at").alias("s"))
    return mapping.join(last, "package_id", "left").select("package_id", "project_key", "s.scanned_at", "s.total_usd", "s.status")


def network_summary(packages: DataFrame, objects: DataFrame, transactions: DataFrame, discoveries: DataFrame, projects: DataFrame, gaps: DataFrame, as_of: str, since: str, min_usd: float) -> DataFrame:
    """One row: packages, new ones since a time, active objects, transactions to enrich, packages by how they were found, projects by their status now, and open gaps of checkpoints.

    A project counts as incomplete when it is stored so, the provider's answer lacked it, it has no
    packages or its data is older than half an hour.
    """
    is_new = F.col("first_seen_at") >= F.lit(since).cast("timestamp")
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("seen_at")
    now = S.current_project_status(F.col("status"), F.col("complete"), F.size("packages"), age, F.col("indexed_tvl"), min_usd)
    open_ = gaps.where("status = 'active'")
    parts = [
        packages.agg(F.count("*").alias("packages"), F.count_if(is_new).alias("new_packages")),
        objects.agg(F.count_if(F.col("active") == 1).alias("objects")),
        transactions.agg(F.count_if(F.col("enriched") == 0).alias("pending")),
        discoveries.agg(*(F.count_if(F.col("source") == x).alias(x) for x in ("publish", "active_call"))),
        projects.select(now.alias("now")).agg(*(F.count_if(F.col("now") == x).alias(x) for x in ("qualifying", "below", "incomplete"))),
        open_.agg(F.count("*").alias("open_gaps"), F.coalesce(F.sum(F.col("end_checkpoint") - F.col("next_checkpoint") + 1), F.lit(0)).alias("gap_remaining")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(x)  # one row each
    return out


def project_report(projects: DataFrame, as_of: str, min_usd: float, outage: bool = False) -> DataFrame:
    """Projects (project_name, indexed_tvl, status, packages, verified_pool_tvl, verified_pool_count, pool_count, complete, seen_at, note) as report rows with their kind.

    Verified pools are evidence beside the indexed value, never added to it.  Old data, or data of a
    provider that is out, is marked in the notes; the status is as stored.
    """
    tvl = F.coalesce("indexed_tvl", F.lit(0.0))
    status = F.when((F.col("status") == "incomplete") | (F.size("packages") == 0), "incomplete").when(tvl >= min_usd, "qualifying").otherwise("below")
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("seen_at")
    stale = F.lit(outage) | (F.coalesce(age, F.lit(1 << 40)) > 1800) | ~F.col("complete")
    count = lambda c: F.coalesce(c, F.lit(0))
    notes = F.concat(F.lit("indexed value; verified pools are evidence only and not added to it"), F.when(stale, F.concat(F.lit("; snapshot stale since "), F.coalesce(F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")))).otherwise(""), F.coalesce(F.concat(F.lit("; "), F.nullif("note", F.lit(""))), F.lit("")))
    return projects.select(
        F.col("project_name").alias("project"), tvl.alias("indexed_tvl"), status.alias("status"), F.substring(F.array_join("packages", "; "), 1, 32_000).alias("packages"), F.coalesce("verified_pool_tvl", F.lit(0.0)).alias("verified_pool_tvl"),
        count("verified_pool_count").alias("verified_pools"), count("pool_count").alias("known_pools"), F.concat_ws("/", count("verified_pool_count"), count("pool_count")).alias("verification_coverage"), F.col("seen_at").alias("synced"), notes.alias("notes"),
    )
