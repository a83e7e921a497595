"""Crawl rules: delay, decision and freshness of robots texts, as column expressions.

Nothing here fetches: the texts come as a table of fetch results and a cache table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENT = "RecipeScraper"
MOST_BYTES = 500 * 1024
TTL_SECONDS = 86_400


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "^[\\t\\r ]+|[\\t\\r ]+$", "")))


def crawl_delay(text: Column, agent: str = AGENT) -> Column:
    """Last valid delay of the agent's own group, else that of `*`; each agent line opens a group."""
    start = F.struct(F.lit("").alias("group"), F.lit(None).cast("double").alias("own"), F.lit(None).cast("double").alias("any"))

    def step(state: Column, line: Column) -> Column:
        names = line.rlike("^[Uu]ser-agent:")
        said = F.regexp_extract(line, r"^[Cc]rawl-delay:\s*(\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$", 1)
        delay = F.when(said != "", said).try_cast("double")
        return F.struct(
            F.when(names, F.lower(F.trim(F.substring(line, 12, 1 << 30)))).otherwise(state["group"]).alias("group"),
            F.when(~names & (state["group"] == agent.lower()), F.coalesce(delay, state["own"])).otherwise(state["own"]).alias("own"),
            F.when(~names & (state["group"] == "*"), F.coalesce(delay, state["any"])).otherwise(state["any"]).alias("any"),
        )

    return F.aggregate(_lines(text), start, step, lambda s: F.coalesce(s["own"], s["any"]))


def fetch_status(code: Column, n_bytes: Column) -> Column:
    """ok, not_found, oversized or unreachable; a null code is a failed fetch."""
    return F.when(code.isin(404, 410), "not_found").when(code.isNull() | (code < 200) | (code >= 300), "unreachable").when(n_bytes > MOST_BYTES, "oversized").otherwise("ok")


def _permits(text: Column, path: Column, agent: str) -> Column:
    """Longest matching rule of the agent's groups, else of `*`; Allow wins a tie."""
    start = F.struct(F.array().cast("array<string>").alias("group"), F.lit(True).alias("open"), F.array().cast("array<struct<own:boolean,allow:boolean,rule:string>>").alias("rules"), F.lit(False).alias("seen"))

    def step(s: Column, line: Column) -> Column:
        key = F.lower(F.trim(F.regexp_extract(line, "^([^:#]*):", 1)))
        value = F.trim(F.regexp_extract(line, "^[^:#]*:([^#]*)", 1))
        names, rules = key == "user-agent", key.isin("allow", "disallow")
        named = F.when(names & s["open"], F.array_append(s["group"], F.lower(value))).when(names, F.array(F.lower(value))).otherwise(s["group"])
        own, everyone = F.array_contains(s["group"], agent.lower()), F.array_contains(s["group"], "*")
        rule = F.struct(F.coalesce(own, F.lit(False)).alias("own"), (key == "allow").alias("allow"), value.alias("rule"))
        return F.struct(
            named.alias("group"),
            F.when(names, True).when(rules, False).otherwise(s["open"]).alias("open"),
            F.when(rules & (own | everyone) & (value != ""), F.array_append(s["rules"], rule)).otherwise(s["rules"]).alias("rules"),
            (s["seen"] | (names & (F.lower(value) == agent.lower()))).alias("seen"),
        )

    def verdict(s: Column) -> Column:
        def regex(rule: Column) -> Column:
            quoted = F.regexp_replace(rule, r"([\\\[\](){}.^+?|])", r"\\$1")
            return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))

        fitting = F.filter(s["rules"], lambda r: (r["own"] == s["seen"]) & F.regexp(path, regex(r["rule"])))
        best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["allow"].alias("allow"))))
        return F.coalesce(best["allow"], F.lit(True))

    return F.aggregate(_lines(text), start, step, verdict)


def decided(df: DataFrame, agent: str = AGENT) -> DataFrame:
    """`df` (status, text, path, stale) with allowed, reason and matched_agent."""
    status, empty = F.col("status"), F.coalesce(F.col("text"), F.lit("")) == ""
    own, any_ = F.col("own_allowed"), F.col("any_allowed")
    df = df.withColumns({"own_allowed": _permits(F.col("text"), F.col("path"), agent), "any_allowed": _permits(F.col("text"), F.col("path"), "*")})
    read = (status == "ok") & ~empty
    matched = F.when(read & (own != any_), agent).otherwise("*")
    allowed = F.when(status.isin("not_found", "oversized") | ((status == "ok") & empty), True).when(read, own).otherwise(False)
    # The reasons.
    reason = (
        F.when(status == "not_found", "robots.txt not found — allowed per RFC 9309")
        .when(status == "unreachable", "robots.txt unreachable")
        .when(status == "oversized", "robots.txt oversized — treated as empty per policy")
        .when(read & own, "allowed by robots.txt")
        .when(read, F.concat(F.lit("disallowed by User-agent: "), matched))
        .when(status == "ok", "empty robots.txt — no restrictions")
        .otherwise(F.concat(F.lit("unknown robots.txt status: "), status))
    )
    suffix = F.when(F.col("stale"), " (stale cache)").otherwise("")
    return df.select("*", allowed.alias("allowed"), F.concat(reason, suffix).alias("reason"), matched.alias("matched_agent")).drop("own_allowed", "any_allowed")


def fresh(fetched_at: Column, now: Column) -> Column:
    """Younger than the cache's day; a time to come is fresh, a null one is not."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(fetched_at) < TTL_SECONDS, F.lit(False))


def rough_seconds(text: Column) -> Column:
    """Seconds of a time's text in years of 365 and months of 30 days; null where it is no time."""
    part = lambda i: F.regexp_extract(text, r"^\+?([0-9]+)-\+?([0-9]+)-\+?([0-9]+)[^T ]*[T ]\+?([0-9]+):\+?([0-9]+):\+?([0-9]+)(?:\..*)?Z?$", i).try_cast("bigint")
    return part(1) * 31_536_000 + part(2) * 2_592_000 + part(3) * 86_400 + part(4) * 3600 + part(5) * 60 + part(6)


def roughly_fresh(fetched_at: Column, now: Column) -> Column:
    """`fresh` by `rough_seconds`: entries look younger or older where months have not 30 days."""
    return F.coalesce(rough_seconds(now) - rough_seconds(fetched_at) < TTL_SECONDS, F.lit(False))


def cache_latest(log: DataFrame) -> DataFrame:
    """Newest entry (domain, text, status, fetched_at) of each domain."""
    return log.groupBy("domain").agg(F.max_by(F.struct("text", "status"), "fetched_at").alias("v"), F.max("fetched_at").alias("fetched_at")).select("domain", "v.text", "v.status", "fetched_at")


def pruned(cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Entries of the last `days` days."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= days * 86_400)


def pruned_by_text(cache: DataFrame, now_text: Column, days: int = 7) -> DataFrame:
    """As `pruned` for times kept as text `…T…Z`, compared as text with a time that has a space for the T.

    So entries of the whole day at the edge stay.
    """
    edge = F.date_format(F.to_timestamp(F.translate(F.substring(now_text, 1, 19), "T", " ")) - F.make_interval(days=F.lit(days)), "yyyy-MM-dd HH:mm:ss")
    return cache.where(F.col("fetched_at") >= edge)


def fetched_rules(fetches: DataFrame) -> DataFrame:
    """robots_url, text and status of fetched crawl rules (robots_url, code, body); only good ones have a text."""
    status = fetch_status(F.col("code"), F.octet_length("body"))
    return fetches.select("robots_url", F.when(status == "ok", F.coalesce(F.col("body").cast("string"), F.lit(""))).otherwise("").alias("text"), status.alias("status"))


def cache_policy(requests: DataFrame, cache: DataFrame, fetches: DataFrame, now: Column, is_fresh=fresh) -> DataFrame:
    """`requests` (domain, robots_url, ...) with text, status, source and stale.

    `cache` has one row a domain, `fetches` what fetching each robots_url gives. A fresh
    entry is used as it is; an old one only if its refetch is unreachable, and then it is
    stale; else the fetch counts. The cache's key is the host alone. A request whose rules
    nobody fetched is unreachable.
    """
    held = cache.select(F.col("domain").alias("c_domain"), F.col("text").alias("c_text"), F.col("status").alias("c_status"), is_fresh(F.col("fetched_at"), now).alias("c_fresh"))
    got = fetched_rules(fetches).select(F.col("robots_url").alias("f_url"), F.col("text").alias("f_text"), F.col("status").alias("f_status"))
    rows = requests.join(held, F.col("domain") == F.col("c_domain"), "left").join(got, F.col("robots_url") == F.col("f_url"), "left")
    there, new = F.col("c_domain").isNotNull(), F.coalesce("f_status", F.lit("unreachable"))
    cached = there & (F.col("c_fresh") | (new == "unreachable"))
    return rows.select(
        *requests.columns,
        F.when(cached, F.col("c_text")).otherwise(F.coalesce("f_text", F.lit(""))).alias("text"),
        F.when(cached, F.col("c_status")).otherwise(new).alias("status"),
        F.when(cached, "cached").otherwise("fresh").alias("source"),
        (cached & ~F.col("c_fresh")).alias("stale"),
    )


def refreshed(requests: DataFrame, cache: DataFrame, fetches: DataFrame, now: Column, is_fresh=fresh) -> DataFrame:
    """The cache (domain, text, status, fetched_at) after the requests' fetches are in it."""
    new = cache_policy(requests, cache, fetches, now, is_fresh).where("source = 'fresh'")
    new = new.groupBy("domain").agg(F.min_by(F.struct("text", "status"), "robots_url").alias("v")).select("domain", "v.text", "v.status", now.cast(cache.schema["fetched_at"].dataType).alias("fetched_at"))
    return cache.join(new, "domain", "left_anti").select("domain", "text", "status", "fetched_at").unionByName(new)


def checked(requests: DataFrame, cache: DataFrame, fetches: DataFrame, now: Column, agent: str = AGENT, is_fresh=fresh) -> DataFrame:
    """`requests` (domain, robots_url, path, ...) with allowed, reason, delay, matched_agent and source."""
    rows = decided(cache_policy(requests, cache, fetches, now, is_fresh), agent)
    delay = F.when((F.col("status") == "ok") & (F.col("text") != ""), crawl_delay(F.col("text"), agent))
    return rows.select(*requests.columns, "allowed", "reason", delay.alias("delay"), "matched_agent", "source")


def fetch_error(code: Column, content_type: Column, n_bytes: Column) -> Column:
    """Why a fetched page is refused: http, content_type or size; null where it is accepted."""
    return F.when(code >= 400, "http").when(~F.coalesce(content_type, F.lit("")).startswith("text/html"), "content_type").when(n_bytes > 10_485_760, "size")
