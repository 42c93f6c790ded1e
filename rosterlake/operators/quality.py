"""Component quality score.

Two parameter sets share one shape: ten capped components, a total capped at
100 and a grade.  Everything is a projection over one row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, regex
from ..functions.arrays import computed_once
from ..rules import patterns

COMPONENTS = (
    "data_source", "maintenance", "documentation", "mcp_compliance", "tool_schema",
    "health", "repository", "license", "security", "community",
)

# --- fixed values: points of the two generations -----------------------------
ENGINE = {
    "data_source": {"official_gov_api": 20, "open_data": 18, "official_company": 15, "official": 15,
                    "third_party_api": 10, "community": 7},
    "transport": {"stdio": 3, "sse": 3, "http": 3, "streamable-http": 2, "websocket": 2},
    "multi_transport": 2,
    "short_description": 3,
    "permissive": ("MIT", "Apache-2.0", "Apache 2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC",
                   "Unlicense", "MIT-0"),
    "no_license": ("", "UNKNOWN", "unknown"),
}
LEGACY = {
    "data_source": {"official_gov_api": 20, "gov_open_data": 18, "official_company": 15, "official": 14,
                    "open_data": 12, "third_party_api": 10, "community": 8, "web_scraping": 7,
                    "unknown": 0},
    "transport": {"stdio": 3, "sse": 3, "http": 3, "streamable-http": 2},
    "multi_transport": 0,
    "short_description": 0,
    "permissive": ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"),
    "no_license": ("", "UNKNOWN"),
    "severity_penalty": {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 5},
}


def _flag(cond: Column, points=1) -> Column:
    return F.when(cond, points).otherwise(0)


def _lookup(table: dict, key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(0))


def best_data_source(types: Column, table: dict) -> Column:
    """Best of the known source types, 0 when there is none."""
    return F.coalesce(F.array_max(F.transform(types, lambda t: _lookup(table, t))), F.lit(0))


def documentation(description: Column, tool_count: Column, short_points: int) -> Column:
    size = F.octet_length(description)
    return (F.when(size > 200, 5).when(size > 50, short_points).otherwise(0)
            + _flag(tool_count > 0, 3) + _flag(tool_count >= 5, 2))


def compliance(transports: Column, table: dict, multi_bonus: int) -> Column:
    base = F.aggregate(transports, F.lit(0), lambda acc, t: acc + _lookup(table, t))
    return F.least(base + _flag(F.size(transports) > 0, 5)
                   + _flag(F.size(transports) >= 2, multi_bonus), F.lit(15))


def inferred_transports(endpoints: Column) -> Column:
    """Stated transport, else one guessed from scheme and TLS; distinct."""
    return F.array_distinct(F.transform(endpoints, lambda e: F.coalesce(
        F.nullif(e["transport"], F.lit("")),
        F.when(e["url"].rlike("^https?://"), F.when(e["tls"], "sse").otherwise("http")).otherwise("stdio"))))


def license_points(license_: Column, params: dict) -> Column:
    return F.when(license_.isin(*params["no_license"]), 0) \
            .otherwise(3 + _flag(license_.isin(*params["permissive"]), 2))


def _star_steps(stars: Column) -> Column:
    return _flag(stars >= 10) + _flag(stars >= 50) + _flag(stars >= 100)


def _has_described_tool() -> Column:
    return F.exists("tools", lambda t: (t["name"] != "") & (t["description"] != ""))


def _has_schema() -> Column:
    return F.exists("tools", lambda t: ~F.coalesce(t["input_schema"], F.lit("")).isin("", "{}", "null"))


def engine_components(as_of: Column, params=ENGINE) -> dict:
    c, n_tools = F.col, F.size("tools")
    critical = regex.any_of([regex.matches(c("raw_content"), p) for p in patterns.QUALITY_CRITICAL])
    return {
        "data_source": best_data_source(F.transform("data_sources", lambda d: d["type"]), params["data_source"]),
        "maintenance": bands.maintenance_points(c("pushed_at"), as_of),
        "documentation": documentation(c("description"), n_tools, params["short_description"]),
        "mcp_compliance": compliance(inferred_transports(c("endpoints")), params["transport"],
                                     params["multi_transport"]),
        "tool_schema": F.least(_flag(n_tools > 0, 3) + _flag(_has_described_tool(), 3)
                               + _flag(_has_schema(), 2) + _flag(n_tools >= 5, 2), F.lit(10)),
        "health": F.when(F.exists("endpoints", lambda e: F.startswith(e["url"], F.lit("https://"))), 10)
                   .when((F.size("endpoints") > 0) | (c("repo_url") != ""), 5).otherwise(0),
        "repository": _flag(c("repo_url") != "", 3) + _flag(c("stars") >= 10) + _flag(c("forks") >= 5),
        "license": license_points(c("license"), params),
        "security": _flag(~critical, 5),
        "community": _star_steps(c("stars")) + _flag(c("forks") >= 5) + _flag(F.size("topics") > 0),
    }


def legacy_components(as_of: Column, params=LEGACY, finding_severities="finding_severities") -> dict:
    """``finding_severities`` names an array<string> column of severities."""
    c, n_tools = F.col, F.size("tools")
    penalty = F.aggregate(c(finding_severities), F.lit(0),
                          lambda acc, s: acc + _lookup(params["severity_penalty"], s))
    health = F.upper(c("health"))
    return {
        "data_source": best_data_source(F.transform("data_sources", lambda d: d["type"]), params["data_source"]),
        "maintenance": bands.maintenance_points(c("pushed_at"), as_of),
        "documentation": documentation(c("description"), n_tools, params["short_description"]),
        "mcp_compliance": compliance(c("transport"), params["transport"], params["multi_transport"]),
        "tool_schema": _flag(n_tools > 0, 3) + _flag(_has_described_tool(), 3) + _flag(_has_schema(), 2)
                       + _flag(_has_schema() & (n_tools >= 5)),
        "health": F.when(health == "HEALTHY", 10).when(health == "DEGRADED", 5).otherwise(0),
        "repository": _flag(c("repo_url") != "", 3) + _flag(c("stars") >= 10),
        "license": license_points(c("license"), params),
        "security": F.greatest(F.lit(5) - penalty, F.lit(0)),
        "community": _star_steps(c("stars")) + _flag(c("open_issues") > 0) + _flag(F.size("topics") > 0),
    }


def add(df: DataFrame, components: dict, out="quality") -> DataFrame:
    """Adds struct<score, grade, components>."""
    parts = f"_{out}_parts"
    total = F.least(sum((F.col(parts)[k] for k in COMPONENTS), F.lit(0)), F.lit(100))
    return (df
            .withColumn(parts, F.struct(*[components[k].cast("int").alias(k) for k in COMPONENTS]))
            .transform(computed_once, out, F.struct(total.alias("score"), bands.grade(total).alias("grade"),
                                      F.col(parts).alias("components")))
            .drop(parts))
