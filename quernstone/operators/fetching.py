"""What comes back from the web: accepted pages, refusals with their messages, the way from URL to page.

Nothing here opens a connection. Fetch results are a table (url, code, content_type,
content_length, body as binary, final_url, failure, failure_kind) that a crawler writes;
these expressions decide on its rows. A refused row has its error in a struct, so that
one bad page never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import urls
from quernstone.operators import robots

MOST_BYTES = 10_485_760
#: What a client that fills the fetch table must keep to.
CLIENT = {"user_agent": "RecipeScraper/1.0", "timeout_seconds": 30, "redirects": 5, "robots_timeout_seconds": 10}

# Named HTTP codes.
CODES = {
    400: "Bad request", 401: "Unauthorized", 403: "Forbidden", 404: "Page not found", 405: "Method not allowed", 408: "Request timeout",
    410: "Gone", 429: "Too many requests", 500: "Internal server error", 502: "Bad gateway", 503: "Service unavailable", 504: "Gateway timeout",
}

ERROR = "struct<error_type:string,message:string,url:string,details:string,status_code:int,content_type:string,max_bytes:int,reason:string>"


def http_message(code: Column) -> Column:
    """The name of a code with the code in brackets."""
    names = F.create_map(*(F.lit(x) for item in CODES.items() for x in item))
    return F.concat(F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("HTTP error")), F.lit(" ("), code.cast("int").cast("string"), F.lit(")"))


def network_message(kind: Column, failure: Column) -> Column:
    """Why no answer came: timeout, then connection, then words of name resolution in the failure's text."""
    low = F.lower(failure)
    dns = low.contains("dns") | low.contains("resolve") | low.contains("no such host")
    return F.when(kind == "timeout", "Request timed out after 30 seconds").when(kind == "connect", "Connection failed").when(dns, "DNS resolution failed").otherwise(F.concat(F.lit("Network error: "), failure))


def _error(kind: str, message: Column, url: Column, **more: Column) -> Column:
    names = {"error_type": F.lit(kind), "message": message, "url": url} | more
    columns = ("error_type", "message", "url", "details", "status_code", "content_type", "max_bytes", "reason")
    return F.struct(*(names.get(n, F.lit(None)).alias(n) for n in columns)).cast(ERROR)


def refusal(url: Column, code: Column, content_type: Column, content_length: Column, body: Column, failure: Column, failure_kind: Column) -> Column:
    """The error of a fetch result, null where the page is accepted.

    In this order: no answer; a code of 400 to 599; a content type that does not begin
    with text/html, a missing one too; a body beyond the limit by its header or in
    truth; bytes that are no UTF-8.
    """
    kind = F.coalesce(content_type, F.lit(""))
    held = F.octet_length(body)
    size = F.when(content_length > MOST_BYTES, content_length).when(held > MOST_BYTES, held)
    too_large = F.concat(F.lit("Response too large: "), size.cast("string"), F.lit(f" bytes (max {MOST_BYTES} bytes)"))
    details = F.when(~F.coalesce(failure_kind == "timeout", F.lit(False)), failure)
    return (
        F.when(failure.isNotNull() | failure_kind.isNotNull(), _error("network", network_message(failure_kind, F.coalesce(failure, F.lit(""))), url, details=details))
        .when((code >= 400) & (code < 600), _error("http", http_message(code), url, status_code=code))
        .when(~kind.startswith("text/html"), _error("content_type", F.concat(F.lit("Expected HTML but received "), kind), url, content_type=kind))
        .when(size.isNotNull(), _error("size", too_large, url, max_bytes=F.lit(MOST_BYTES)))
        .when(body.isNotNull() & ~F.is_valid_utf8(body.cast("string")), _error("content_type", F.lit("Response is not valid UTF-8"), url, content_type=F.lit("text/html")))
    )


def accepted(fetches: DataFrame) -> DataFrame:
    """url, status_code, content_type, final_url (where it differs), html and error of every fetch result; further columns stay."""
    c = F.col
    further = [n for n in fetches.columns if n not in ("url", "code", "content_type", "content_length", "body", "final_url", "failure", "failure_kind")]
    error = refusal(c("url"), c("code"), c("content_type"), c("content_length"), c("body"), c("failure"), c("failure_kind"))
    rows = fetches.withColumn("error", error)
    good = c("error").isNull()
    return rows.select(
        *further,
        "url",
        F.when(good, c("code").cast("int")).alias("status_code"),
        F.when(good, c("content_type")).alias("content_type"),
        F.when(good & (c("final_url") != c("url")), c("final_url")).alias("final_url"),
        F.when(good, c("body").cast("string")).alias("html"),
        "error",
    )


def error_type(error: Column) -> Column:
    return error["error_type"]


def ingested(requests: DataFrame, cache: DataFrame, robots_fetches: DataFrame, fetches: DataFrame, now: Column) -> DataFrame:
    """url (as asked), normalized, html, status_code, content_type, final_url and error of every request.

    Validity, normal form, crawl rules, then the fetch result of the normal form; what
    fails first is the error. A request without a fetch result is a network error.
    """
    asked = urls.resolved(requests.select(F.col("url").alias("asked")), "asked").select("asked", "parts.*")
    path = F.concat("path", F.coalesce(F.concat(F.lit("?"), "query"), F.lit("")))
    good = asked.where("error is null").select("asked", F.col("host").alias("domain"), path.alias("path"), "robots_url", F.col("normalized").alias("url"))
    ruled = robots.checked(good, cache, robots_fetches, now).select("asked", "url", "allowed", "reason")
    pages = accepted(fetches).withColumnRenamed("url", "page_url")
    joined = ruled.join(pages, F.col("allowed") & (F.col("url") == F.col("page_url")), "left")
    error = (
        F.when(~F.col("allowed"), _error("robots_disallowed", F.lit("Scraping disallowed by robots.txt"), F.col("url"), reason=F.col("reason")))
        .when(F.col("page_url").isNull(), _error("network", F.lit("Network error: no fetch result"), F.col("url"), details=F.lit("no fetch result")))
        .otherwise(F.col("error"))
    )
    done = joined.select(F.col("asked").alias("url"), F.col("url").alias("normalized"), "html", "status_code", "content_type", "final_url", error.alias("error"))
    none = F.lit(None).cast("string")
    failed = asked.where("error is not null").select(F.col("asked").alias("url"), none.alias("normalized"), none.alias("html"), F.lit(None).cast("int").alias("status_code"), none.alias("content_type"), none.alias("final_url"), _error("validation", F.col("error"), F.col("asked")).alias("error"))
    return done.unionByName(failed)
