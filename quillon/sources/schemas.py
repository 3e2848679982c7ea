"""The tables of a wiki store by name, with the types that Spark reads them in; and readers over Parquet folders or a database."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Enumerations are all of one shape.
ENUMERATIONS = "namespace revision_kind document_reference_kind verification_purpose notification_kind permission acl_action acl_condition_kind thread_status thread_comment_kind edit_request_status".split()
_TABLES = {
    "license": "id long, name string, display_name string, source_url string",
    "credential_kind": "id long, name string, allows_multiple boolean",
    "wiki_user": "id long, external_id string, name string, is_system boolean, created_at timestamp",
    "actor": "id long, user_id long, ip_address string",
    "user_credential": "id long, user_id long, kind_id long, label string, identifier string, secret string, verified_at timestamp, last_used_at timestamp, is_primary boolean, created_at timestamp",
    "user_verification": "id long, user_id long, credential_id long, purpose_id long, token_hash string, expires_at timestamp, consumed_at timestamp, created_at timestamp",
    "login_record": "id long, user_id long, credential_id long, ip_address string, user_agent string, succeeded boolean, created_at timestamp",
    "user_preference": "user_id long, name string, data string",
    "notification": "id long, user_id long, kind_id long, payload string, read_at timestamp, created_at timestamp",
    "document": "id long, namespace_id long, title string, created_at timestamp",
    "revision": "id long, external_id string, document_id long, sequence long, kind_id long, actor_id long, content string, comment string, metadata string, content_bytes long, hidden boolean, created_at timestamp",
    "document_reference": "source_document_id long, target_namespace_id long, target_title string, kind_id long",
    "star": "user_id long, document_id long, created_at timestamp",
    "file_content": "hash string, media_type string, byte_size long, width int, height int, created_at timestamp",
    "file_revision": "revision_id long, content_hash string, license_id long",
    "acl_rule": "id long, document_id long, namespace_id long, action_id long, evaluation_order long, condition_kind_id long, condition_value string, allowed boolean",
    "acl_group": "id long, name string, created_at timestamp",
    "acl_group_member": "id long, group_id long, actor_id long, ip_range string, reason string, expires_at timestamp, added_by long, created_at timestamp, removed_at timestamp, removed_by long",
    "user_permission": "id long, user_id long, permission_id long, granted_by long, created_at timestamp, revoked_at timestamp, revoked_by long",
    "thread": "id long, external_id string, document_id long, topic string, status_id long, created_at timestamp",
    "thread_comment": "id long, thread_id long, sequence long, kind_id long, actor_id long, content string, metadata string, admin_marked boolean, hidden_at timestamp, hidden_by long, created_at timestamp",
    "edit_request": "id long, external_id string, document_id long, base_revision_id long, actor_id long, content string, comment string, status_id long, reviewed_by long, created_at timestamp",
    "site_setting": "name string, data string",
    "session": "id string, data binary, expires_at timestamp",
}
TABLES = {n: "id long, name string" for n in ENUMERATIONS} | _TABLES


@cache
def schema(name: str) -> StructType:
    """A table's type; Spark reads the text, so there must be a session."""
    return StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table of a store kept as Parquet folders, in the types stated here whatever the files leave out."""
    return spark.read.schema(schema(name)).parquet(f"{path.rstrip('/')}/{name}")


def read_database(spark: SparkSession, name: str, url: str, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database, by JDBC, with as many connections at once as parts where it has an id to split by; filters and columns
    are pushed down. The driver class must be on Spark's path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if "id" in schema(name).fieldNames() and schema(name)["id"].dataType.simpleString() == "bigint":
        low, high = (reader.load().selectExpr("min(id)", "max(id)").first()) or (0, 0)
        if low is not None and high > low:
            reader = reader.option("partitionColumn", "id").option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load().select(*[f"`{f.name}`" for f in schema(name).fields])


def broken_rows(name: str, table: DataFrame) -> DataFrame:
    """Rows that break what the store promises: an actor is a user or an address, a rule of a document or of a namespace, a member an
    actor or a range, one of each; ids and the columns that name something are not null."""
    one_of = {"actor": ("user_id", "ip_address"), "acl_rule": ("document_id", "namespace_id"), "acl_group_member": ("actor_id", "ip_range")}
    bad = " OR ".join(f"{c} IS NULL" for c in schema(name).fieldNames() if c in ("id", "name", "title", "hash", "sequence", "document_id") and c not in one_of.get(name, ()))
    if name in one_of:
        a, b = one_of[name]
        bad = f"({bad}) OR ({a} IS NULL) = ({b} IS NULL)" if bad else f"({a} IS NULL) = ({b} IS NULL)"
    return table.where(bad or "false")
