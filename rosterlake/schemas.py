"""Column layout of the canonical entity table.

One wide row per entity: hot scalars as plain columns so filters reach the
parquet scan, nested parts as arrays of structs, long facts (evidence,
findings, endpoints) as separate long tables.
"""

from pyspark.sql import DataFrame, functions as F

ENDPOINT = "struct<url:string,transport:string,tls:boolean,type:string>"
TOOL = "struct<name:string,description:string,input_schema:string>"
RESOURCE = "struct<uri:string,name:string,description:string>"
PROMPT = "struct<name:string,description:string>"
DATA_SOURCE = "struct<name:string,type:string,url:string,official:boolean>"
SOURCE_REF = "struct<source:string,url:string,trust_score:double>"
EVIDENCE = "struct<type:string,source:string,rule:string,matched:string,score:double,confidence:double>"

ENTITY_COLUMNS = {
    "id": "string", "name": "string", "slug": "string", "description": "string",
    "raw_content": "string",
    "repo_url": "string", "repo_owner": "string", "repo_name": "string", "homepage": "string",
    "language": "string", "license": "string", "topics": "array<string>",
    "package_files": "map<string,string>",
    "stars": "int", "forks": "int", "open_issues": "int", "archived": "boolean",
    "created_at": "timestamp", "pushed_at": "timestamp",
    "endpoints": f"array<{ENDPOINT}>", "tools": f"array<{TOOL}>",
    "resources": f"array<{RESOURCE}>", "prompts": f"array<{PROMPT}>",
    "data_sources": f"array<{DATA_SOURCE}>", "sources": f"array<{SOURCE_REF}>",
    "transport": "array<string>", "categories": "array<string>",
    "entity_status": "string", "identity_status": "string", "runtime_status": "string",
    "security_status": "string", "health": "string",
    "region_score": "double", "region_level": "string",
    "ai_score": "double", "ai_level": "string", "primary_class": "string",
    "quality_score": "int", "quality_grade": "string",
    "first_seen": "timestamp", "last_seen": "timestamp",
}



def _default(kind: str):
    if kind.startswith("array"):
        return F.array().cast(kind)
    if kind.startswith("map"):
        return F.create_map().cast(kind)
    if kind == "string":
        return F.lit("")
    if kind in ("int", "double"):
        return F.lit(0).cast(kind)
    if kind == "boolean":
        return F.lit(False)
    return F.lit(None).cast(kind)


def with_defaults(df: DataFrame, only=None) -> DataFrame:
    """Adds missing entity columns and fills NULLs, so operators need no guards.

    ``only`` limits the additions to the columns an operator reads, which keeps
    the scan narrow.
    """
    wanted = ENTITY_COLUMNS if only is None else {c: ENTITY_COLUMNS[c] for c in only}
    have = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(F.col(c), _default(have[c])) if c in have else _default(kind)
        for c, kind in wanted.items()})
