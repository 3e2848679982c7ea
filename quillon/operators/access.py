"""Permissions, discussions, notifications.

Defined results: null keys match nothing in joins; an address or network that can't be read matches nothing; rules without a document and
a namespace apply nowhere; memberships and actors in several rows count once; empty tables give empty results, and a request without
any rule is denied. Every top-k has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registered import scalar
from ..sources.storage import stored
from .pages import display, with_author, with_titles


def ipv4(address: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = F.split(address, r"\.")
    byte = lambda i: F.get(part, i).try_cast("long")
    ok = address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, byte(0) * 16777216 + byte(1) * 65536 + byte(2) * 256 + byte(3))


def in_range(address: Column, cidr: Column) -> Column:
    """Whether an IPv4 address lies in a network `a.b.c.d/n`; false for what can't be read."""
    length = F.substring_index(cidr, "/", -1).try_cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - length)
    return F.coalesce(F.floor(ipv4(address) / size) == F.floor(ipv4(F.substring_index(cidr, "/", 1)) / size), F.lit(False)) & F.coalesce(length.between(0, 32), F.lit(False))


def active_members(w, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return w.acl_group_member.where(F.col("removed_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("name", "actor_id").distinct()


def candidate_rules(w, action: str) -> DataFrame:
    """Rules by document: its own and its namespace's, by two equi-joins instead of one with OR."""
    rules = w.acl_rule.where(F.col("action") == action)
    own = rules.where("document_id IS NOT NULL").select("document_id", F.lit(0).alias("scope"), "evaluation_order", F.col("id").alias("rule_id"), "kind", "value", "allowed")
    by_namespace = w.document.select(F.col("id").alias("document_id"), "namespace_id").join(rules.where("document_id IS NULL").drop("document_id"), "namespace_id")
    return own.unionByName(by_namespace.select("document_id", F.lit(1).alias("scope"), "evaluation_order", F.col("id").alias("rule_id"), "kind", "value", "allowed"))


def in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """Distinct (ip, net) of addresses(ip) and networks(net) of either family where one holds the other. Each address meets the
    networks by the bits that they share, for the lengths that occur, in an equi-join; what can't be read matches nothing."""
    nets = networks.select("net").distinct().withColumn("shared", scalar("net_bits")("net")).where("shared is not null").withColumn("size", F.length("shared"))
    sizes = sorted(r["size"] for r in nets.select("size").distinct().collect())  # at most 162 lengths
    bits = addresses.select("ip").distinct().withColumn("bits", scalar("ip_bits")("ip")).where("bits is not null")
    each = bits.select("ip", "bits", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).where("length(bits) >= size")
    return each.select("ip", "size", F.substr("bits", F.lit(1), F.col("size")).alias("shared")).join(nets, ["size", "shared"]).select("ip", "net")


NAMED, UNNAMED = "named", "unnamed"


def labelled_rules(w, action: str, strict: bool) -> DataFrame:
    """(document_id, namespace_id, who, evaluation_order, rule_id, allowed): rules by whom they are about, named or unnamed actors, or a
    group, user or network by `kind:value`. An unknown permission is about everybody, or about nobody if strict. A rule of a document
    has no namespace."""
    value, kind = F.col("value"), F.col("kind")
    both = F.array(F.lit(NAMED), F.lit(UNNAMED))
    about = F.when(value == "any", both).when(value == "member", F.array(F.lit(NAMED))).when(value == "ip", F.array(F.lit(UNNAMED))).otherwise(F.array().cast("array<string>") if strict else both)
    who = F.when(kind == "perm", about).otherwise(F.array(F.concat_ws(":", kind, value)))
    namespace = F.when(F.col("document_id").isNull(), F.col("namespace_id")).alias("namespace_id")
    return w.acl_rule.where(F.col("action") == action).select("document_id", namespace, F.explode(who).alias("who"), "evaluation_order", F.col("id").alias("rule_id"), "allowed")


def settled_rules(w, action: str, strict: bool) -> DataFrame:
    """(document_id, namespace_id, who, r): the first rule of a document or namespace about each; as many rows as rules at most, each rule
    of anybody counting twice."""
    first = F.min(F.struct("evaluation_order", "rule_id", "allowed")).alias("r")
    return labelled_rules(w, action, strict).groupBy("document_id", "namespace_id", "who").agg(first)


def actor_labels(w, action: str, as_of: str) -> DataFrame:
    """(actor_id, who): what rules can know an actor by: whether they have a name, and of the groups, names and networks that rules name
    those that are true of them."""
    asked = w.acl_rule.where(F.col("action") == action).select("kind", "value").distinct()
    of = lambda kind, name: asked.where(F.col("kind") == kind).select(F.col("value").alias(name))
    all_ = w.actor.select(F.col("id").alias("actor_id"), F.when(F.col("user_name").isNotNull(), NAMED).otherwise(UNNAMED).alias("who"))
    member = active_members(w, as_of).join(of("group", "name"), "name", "left_semi").join(w.actor.select(F.col("id").alias("actor_id")), "actor_id", "left_semi").select("actor_id", F.concat(F.lit("group:"), "name"))
    called = w.actor.join(of("user", "user_name"), "user_name").select("id", F.concat(F.lit("user:"), "user_name"))
    inside = in_networks(w.actor.where("ip is not null").select("ip"), of("ip", "net"))
    return all_.union(member).union(called).union(w.actor.join(inside, "ip").select("id", F.concat(F.lit("ip:"), "net"))).distinct()


def decisions(w, action: str, as_of: str, strict: bool = True) -> DataFrame:
    """Every document's decision for every actor, in a form that grows with rules and actors, never with their product: what the first rule
    of a document or a namespace says about each label (document_id or namespace_id, who, allowed, rule_id), and each actor's labels
    (actor_id, who). An actor may do what the least rule of their labels allows, by evaluation order and id, of the document or else
    of its namespace; none means denied. decided() joins the two for given requests."""
    none = lambda kind: F.lit(None).cast(kind)
    rules = settled_rules(w, action, strict).select("document_id", "namespace_id", none("long").alias("actor_id"), "who", "r.evaluation_order", "r.allowed", "r.rule_id")
    actors = actor_labels(w, action, as_of).select(none("long").alias("document_id"), none("long").alias("namespace_id"), "actor_id", "who", none("int").alias("evaluation_order"), none("boolean").alias("allowed"), none("long").alias("rule_id"))
    return rules.unionByName(actors)


def class_decisions(w, action: str, as_of: str, strict: bool = True) -> DataFrame:
    """Every document's decision for every actor, settled: (document_id, class, allowed, rule_id) for each document and class of actors, and
    (actor_id, class) for each actor. A class is what rules can know its actors by; it shows groups by name, users and networks by
    `kind:value`. First matching rule by scope, order and id; none means denied. Rules are settled for each namespace, and for each
    document that has some; the rows of documents and classes are the answer itself."""
    shown = F.transform(F.filter("labels", lambda x: ~x.isin(NAMED, UNNAMED)), lambda x: F.regexp_replace(x, "^group:(?!group:|user:|ip:)", ""))
    class_ = F.to_json(F.struct(F.array_contains("labels", NAMED).alias("named"), F.array_sort(shown).alias("groups"))).alias("class")
    actors = stored(actor_labels(w, action, as_of).groupBy("actor_id").agg(F.collect_set("who").alias("labels")).select("actor_id", class_, "labels"))
    classes = stored(actors.groupBy("class").agg(F.first("labels").alias("labels")))  # one set of labels a class
    rules = settled_rules(w, action, strict).join(classes.select("class", F.explode("labels").alias("who")), "who")
    own = rules.where("document_id is not null").groupBy("document_id", "class").agg(F.min("r").alias("own"))
    shared = rules.where("document_id is null").groupBy("namespace_id", "class").agg(F.min("r").alias("shared"))
    each = w.document.select(F.col("id").alias("document_id"), F.when(F.col("id").isNotNull(), F.col("namespace_id")).alias("namespace_id")).crossJoin(classes.select("class"))
    settled = each.join(shared, ["namespace_id", "class"], "left").join(own, ["document_id", "class"], "left").withColumn("r", F.coalesce("own", "shared"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return settled.select("document_id", none("long", "actor_id"), "class", F.coalesce("r.allowed", F.lit(False)).alias("allowed"), "r.rule_id").unionByName(
        actors.select(none("long", "document_id"), "actor_id", "class", none("boolean", "allowed"), none("long", "rule_id"))
    )


def decided(w, requests: DataFrame, action: str, as_of: str, strict: bool = True) -> DataFrame:
    """id, allowed, rule_id for each of requests(id, document_id, actor_id), ids being unique: the first matching rule by scope, order and
    id; none means denied. Requests meet rules by label in equi-joins; those of a document or actor that isn't there are denied."""
    rules = settled_rules(w, action, strict)
    named = requests.select("id", "document_id", "actor_id").join(w.document.select(F.col("id").alias("document_id"), "namespace_id"), "document_id")
    asked = named.join(actor_labels(w, action, as_of), "actor_id").select("id", "document_id", "namespace_id", "who")
    own = asked.drop("namespace_id").join(rules.where("document_id is not null").select("document_id", "who", "r"), ["document_id", "who"]).select("id", F.lit(0).alias("scope"), "r.*")
    shared = asked.drop("document_id").join(rules.where("document_id is null").select("namespace_id", "who", "r"), ["namespace_id", "who"]).select("id", F.lit(1).alias("scope"), "r.*")
    first = own.union(shared).groupBy("id").agg(F.min(F.struct("scope", "evaluation_order", "rule_id", "allowed")).alias("r"))
    return requests.select("id").join(first, "id", "left").select("id", F.coalesce("r.allowed", F.lit(False)).alias("allowed"), F.col("r.rule_id").alias("rule_id"))


def permission_log(w, limit: int = 100) -> DataFrame:
    at = F.coalesce("revoked_at", "created_at")
    return w.user_permission.withColumn("at", at).orderBy(F.desc("at"), "user_id").limit(limit).select("user_id", "permission", F.col("revoked_at").isNotNull().alias("revoked"), F.date_format("at", "yyyy-MM-dd").alias("at"))


def granted_permissions(w) -> DataFrame:
    return w.user_permission.where("revoked_at IS NULL").select("user_id", "permission").distinct().orderBy("user_id", "permission")


def threads(w, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest threads first by creation, optionally of one status."""
    d = w.thread if status is None else w.thread.where(F.col("status") == status)
    return with_titles(d.orderBy(F.desc("id")).limit(limit), w.document, w.namespace).select("id", "topic", "status", display().alias("title"))


def threads_of(w, namespace: str, title: str) -> DataFrame:
    """Every thread of one document, newest first by creation."""
    names = w.namespace.where(F.col("name") == namespace).select(F.col("id").alias("namespace_id"))
    document = w.document.where(F.col("title") == title).join(F.broadcast(names), "namespace_id", "left_semi").select(F.col("id").alias("document_id"))
    d = with_titles(w.thread.join(document, "document_id", "left_semi"), w.document, w.namespace)
    return d.orderBy(F.desc("id")).select("id", "topic", "status", display().alias("title"))


def timeline(w) -> DataFrame:
    """Comments in order, hidden ones blank."""
    return w.thread_comment.orderBy("thread_id", "sequence").select("thread_id", "sequence", "author", F.when(F.col("hidden"), F.lit("")).otherwise(F.col("content")).alias("content"), "hidden")


def detail(kind: Column, metadata: Column) -> Column:
    """What a line of a thread's timeline tells besides its text: the new status, topic or document of a change."""
    of = lambda key: F.get_json_object(metadata, f"$.{key}")
    return F.when(kind == "status_change", of("to")).when(kind == "topic_change", of("topic")).when(kind == "document_move", of("document"))


def thread_status_counts(w) -> DataFrame:
    return w.thread.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def open_edit_requests(w, limit: int = 100) -> DataFrame:
    d = w.edit_request.where("status = 'open'").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return with_author(with_titles(d, w.document, w.namespace), w.actor).select("id", display().alias("title"), "author", "created_at")


def notifications(w, user: int, limit: int = 100) -> DataFrame:
    d = w.notification.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return d.select("id", "kind", F.get_json_object("payload", "$.k").cast("long").alias("k"), F.col("read_at").isNotNull().alias("is_read"), "created_at")


def unread_counts(w) -> DataFrame:
    return w.notification.where("read_at IS NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"))


def starred_documents(w, user: int) -> DataFrame:
    return with_titles(w.star.where(F.col("user_id") == user), w.document, w.namespace).orderBy(F.desc("created_at"), "document_id").select(display().alias("title"), "created_at")


def subscribers_fanout(w) -> DataFrame:
    """How many are told of each change: users with a star on the document, the author left out. Stars are counted per document, so no
    pair of a change and a star is made."""
    s = w.star.select("document_id", "user_id").distinct()
    stars = s.groupBy("document_id").agg(F.count(F.lit(1)).alias("stars"))
    own = s.select("document_id", F.col("user_id").alias("actor_id"), F.lit(1).alias("own"))
    d = w.revision.select(F.col("id").alias("revision_id"), "document_id", "actor_id").join(stars, "document_id").join(own, ["document_id", "actor_id"], "left")
    return d.select("revision_id", (F.col("stars") - F.coalesce("own", F.lit(0))).alias("told")).where("told > 0")
