"""Message trees: paths of many threads at once, lineage, integrity, parent rules.

Ancestors are found by pointer doubling: after r rounds every message knows the ancestor 2^r steps
up, and the path set doubles with it, so a thread of depth d takes about log2(d) joins on message
ids. Ids are unique, so no join key is hot however long a thread is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.scale import hot_lag, hot_ordinal
from tracelode.session import checkpoint

CHECKPOINT_EVERY = 2  # the plan doubles with every round in between
TURN_BUCKET = 1024


def role_priority(role: Column) -> Column:
    return F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)


def _rounds(messages: DataFrame) -> int:
    """Doublings needed for the longest thread; one number is read back."""
    size = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(size or 0).bit_length()


def path_nodes(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """(thread_id, leaf_id, message_id, distance) for each leaf and all its known ancestors.

    A leaf on a cycle keeps meeting the same messages; `distance` is then not unique per message,
    which `integrity` reports. Parents outside the thread are not followed.
    """
    links = messages.select("thread_id", F.col("message_id").alias("node"), F.col("parent_id").alias("up"))
    parents = messages.select("thread_id", F.col("message_id").alias("up"), F.lit(True).alias("_there"))
    jump = links.join(parents, ["thread_id", "up"]).select("thread_id", "node", "up")
    path = leaves.select("thread_id", "leaf_id", F.col("leaf_id").alias("node"), F.lit(0).cast("long").alias("distance"))
    path = path.join(links.select("thread_id", "node"), ["thread_id", "node"], "left_semi")
    rounds = _rounds(messages)
    for r in range(rounds):
        step = 1 << r
        reached = path.join(jump, ["thread_id", "node"]).select(
            "thread_id", "leaf_id", F.col("up").alias("node"), (F.col("distance") + step).alias("distance")
        )
        path = path.unionByName(reached)
        if r + 1 == rounds:
            break
        further = jump.select("thread_id", F.col("node").alias("up"), F.col("up").alias("far"))
        jump = jump.join(further, ["thread_id", "up"]).select("thread_id", "node", F.col("far").alias("up"))
        if (r + 1) % CHECKPOINT_EVERY == 0:
            path, jump = checkpoint(path), checkpoint(jump)
    return checkpoint(path).withColumnRenamed("node", "message_id")


def active_path(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Root-to-leaf path of each leaf: `depth` 0 is the root. Leaves that are on a cycle are left out."""
    nodes = path_nodes(messages, leaves)
    cyclic = nodes.groupBy("leaf_id", "message_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leaf_id")
    ends = nodes.groupBy("leaf_id").agg(F.max("distance").alias("_last"))
    return (
        nodes.join(cyclic.distinct(), "leaf_id", "left_anti").join(ends, "leaf_id")
        .withColumn("depth", F.col("_last") - F.col("distance")).drop("_last")
    )


def lineage(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Path restricted to completed messages; `distance` still counts from the leaf."""
    done = messages.where(F.col("status") == "completed").select("message_id")
    return active_path(messages, leaves).join(done, "message_id", "left_semi")


def integrity(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Threads with a cycle, a dangling parent on the active path, a missing leaf or no leaf at all."""
    nodes = path_nodes(messages, leaves)
    cycles = nodes.groupBy("thread_id", "leaf_id", "message_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ids = messages.select("thread_id", F.col("message_id").alias("parent_id"))
    dangling = (
        nodes.select("thread_id", "message_id").join(messages.select("thread_id", "message_id", "parent_id"), ["thread_id", "message_id"])
        .where(F.col("parent_id").isNotNull()).join(ids, ["thread_id", "parent_id"], "left_anti")
    )
    missing = leaves.where(F.col("leaf_id").isNotNull()).join(
        messages.select("thread_id", F.col("message_id").alias("leaf_id")), ["thread_id", "leaf_id"], "left_anti"
    )
    leafless = messages.select("thread_id").distinct().join(
        leaves.where(F.col("leaf_id").isNotNull()), "thread_id", "left_anti"
    )

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select("thread_id").distinct().withColumn("problem", F.lit(name))

    return (
        named(cycles, "cycle").unionByName(named(dangling, "dangling_parent"))
        .unionByName(named(missing, "missing_leaf")).unionByName(named(leafless, "no_leaf"))
    )


def chain_parents(messages: DataFrame) -> DataFrame:
    """Linear history to parent pointers: the previous message of the thread."""
    keyed = messages.withColumn("_role", role_priority(F.col("role")))
    bucket = F.floor(F.col("turn") / TURN_BUCKET)
    return hot_lag(keyed, ["thread_id"], ["turn", "_role", "message_id"], "message_id", bucket, "chained_parent").drop("_role")


def latest_leaf(messages: DataFrame) -> DataFrame:
    """Latest message per thread; at equal times an answer counts as later than its question."""
    late = F.when(F.col("role") == "assistant", 2).when(F.col("role") == "user", 1).otherwise(0)
    return messages.groupBy("thread_id").agg(
        F.max_by("message_id", F.struct("turn", late.alias("r"), "message_id")).alias("leaf_id")
    )


def repaired_leaf(messages: DataFrame) -> DataFrame:
    """Last completed message per thread, null when none is."""
    order = F.struct("turn", role_priority(F.col("role")).alias("r"), "message_id")
    done = F.when(F.col("status") == "completed", order)
    return messages.groupBy("thread_id").agg(F.max_by("message_id", done).alias("last_done"), F.max(done).alias("_any")).select(
        "thread_id", F.when(F.col("_any").isNotNull(), F.col("last_done")).alias("leaf_id")
    )


def parent_choice(requests: DataFrame, messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Parent of each new question, or why there can be none.

    Editing a completed user message makes a sibling of it; otherwise the given parent or the
    thread's active leaf is taken, which must be completed or a failed answer.
    """
    m = messages.select("thread_id", "message_id", "parent_id", "role", "status")
    edited = m.select("thread_id", F.col("message_id").alias("edit_id"), F.col("parent_id").alias("e_parent"),
                      F.col("role").alias("e_role"), F.col("status").alias("e_status"))
    with_leaf = requests.join(leaves, "thread_id", "left").withColumn(
        "_candidate", F.coalesce("wanted_parent", "leaf_id")
    )
    parent = m.select("thread_id", F.col("message_id").alias("_candidate"), F.col("role").alias("p_role"),
                      F.col("status").alias("p_status"))
    joined = with_leaf.join(edited, ["thread_id", "edit_id"], "left").join(parent, ["thread_id", "_candidate"], "left")
    editing = F.col("edit_id").isNotNull()
    bad_edit = F.col("e_role").isNull() | (F.col("e_role") != "user") | (F.col("e_status") != "completed")
    usable = (F.col("p_status") == "completed") | ((F.col("p_role") == "assistant") & (F.col("p_status") == "failed"))
    outcome = (
        F.when(editing & bad_edit, "invalid_edit_message")
        .when(~editing & F.col("_candidate").isNotNull() & ~F.coalesce(usable, F.lit(False)), "invalid_parent_message")
        .otherwise("ok")
    )
    return joined.withColumn("outcome", outcome).withColumn(
        "parent_id",
        F.when(F.col("outcome") == "ok", F.when(editing, F.col("e_parent")).otherwise(F.col("_candidate"))),
    )


def prompt_messages(contexts: DataFrame, lineage_rows: DataFrame, messages: DataFrame, system: str) -> DataFrame:
    """Ordered messages per query: system text, completed history of its thread, the new prompt.

    contexts: query_id, text, context. The thread of a query is the one numbered like it.
    """
    from tracelode.operators.fusion import user_prompt

    first = contexts.select("query_id", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    history = (
        contexts.select("query_id", F.col("query_id").cast("long").alias("thread_id"))
        .join(lineage_rows.select("thread_id", "message_id", "distance"), "thread_id")
        .join(messages.select("message_id", "role", "content"), "message_id")
        .select("query_id", F.lit(1).alias("_k"), (-F.col("distance")).alias("_o"), "role", "content")
    )
    last = contexts.select(
        "query_id", F.lit(2).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit("user").alias("role"),
        user_prompt(F.col("text"), F.col("context")).alias("content"),
    )
    rows = first.unionByName(history).unionByName(last)
    bucket = F.struct("_k", F.floor(F.col("_o") / TURN_BUCKET).alias("b"))
    return hot_ordinal(rows, ["query_id"], [F.col("_k"), F.col("_o")], bucket, "ordinal").withColumn(
        "ordinal", F.col("ordinal") - 1
    )
