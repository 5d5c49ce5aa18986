"""Trees of sampled turns, layer by layer and by pointer doubling: segments of turns that append, and who owns the loss of a shared turn.

A turn has its whole prompt and its output.  It appends to its parent if its prompt begins with the parent's prompt and
output, which lengths and digests of prefixes tell; no path is ever written down for a node.  Leaves come off in layers while
that halves the nodes, so that a tree that branches costs about as much as its last two layers.  A round of doubling joins
what is left with itself by the ancestor 1, 2, 4, ... steps up, so a chain of 100,000 turns takes 17 rounds, and a
parent with a million children is met by salted lookups.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import salted_lookup
from tessera.sources.scratch import scratch

#: So few rows are doubled, which takes fewer rounds than to take their layers off.
SMALL = 100_000


class Rounds:
    """Tables of a computation in rounds, each written before the next."""

    def __init__(self, df: DataFrame):
        self.spark, self.path, self.n = df.sparkSession, scratch(df.sparkSession, "tree"), 0

    def written(self, df: DataFrame) -> DataFrame:
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        self.n += 1
        return self.spark.read.parquet(at)

    def doubled(self, now: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``step`` until no row has a jump.  Each doubles the steps up, so more rounds than a chain of all rows takes mean a cycle."""
        most = math.ceil(math.log2(max(2, now.count()))) + 1
        while not now.where("jump is not null").isEmpty():
            if most < 0:
                raise ValueError("a node is its own ancestor")
            now, most = self.written(step(now)), most - 1
        return now


def peeled(nodes: DataFrame, rounds: Rounds) -> tuple[list[DataFrame], DataFrame]:
    """Layers and core of (node, up, least): a layer has the nodes whose children all lie in layers before it.

    A layer's least values go to its parents as it comes off.  It does while that leaves at most half of the rows, so
    all tables together have at most twice the rows of the first, whatever the depth; the core is what is left (at most
    SMALL rows, or few leaves), with the values below it.
    """
    waits = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("waits"))
    now = rounds.written(nodes.join(waits, "node", "left").select("node", "up", "least", F.coalesce("waits", F.lit(0)).alias("waits")))
    layers, n = [], now.count()
    while n > SMALL and 2 * (left := now.where("waits > 0").count()) <= n:
        layers.append(now.where("waits = 0"))
        told = layers[-1].where("up is not null").groupBy(F.col("up").alias("node")).agg(F.min("least").alias("_least"), F.count(F.lit(1)).alias("_came"))
        met = now.where("waits > 0").join(told, "node", "left")
        now, n = rounds.written(met.select("node", "up", F.least("least", "_least").alias("least"), (F.col("waits") - F.coalesce("_came", F.lit(0))).alias("waits"))), left
    return layers, now


def subtree_min(nodes: DataFrame) -> DataFrame:
    """(node, least) of (node, up, value): the least value of a node and all below it, nulls left out.

    ``up`` is the parent, null or no node for a root.  Layers of leaves come off first.  In the core a node knows after k
    rounds the least value less than 2^k steps below it, and adds that of the nodes 2^k steps below.  Nodes that are
    their own ancestors raise.
    """
    rounds = Rounds(nodes)
    layers, core = peeled(nodes.select("node", "up", F.col("value").alias("least")), rounds)

    def step(now: DataFrame) -> DataFrame:
        below = now.where("jump is not null").groupBy("jump").agg(F.min("least").alias("below")).withColumnRenamed("jump", "node")
        above = now.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        met = salted_lookup(now.join(below, "node", "left"), above, ["jump"], F.col("node"))
        return met.select("node", F.col("next").alias("jump"), F.least("least", "below").alias("least"))

    found = rounds.doubled(core.select("node", F.col("up").alias("jump"), "least"), step)
    return reduce(DataFrame.union, [x.select("node", "least") for x in [found, *layers]])


def chain_roots(nodes: DataFrame) -> DataFrame:
    """(node, root, depth) of (node, up): the ancestor without ``up`` (or whose up is no node), and how many steps up it is.

    The core of the nodes is doubled; layers ask those that are known, the last one that came off first.
    """
    rounds = Rounds(nodes)
    layers, core = peeled(nodes.select("node", "up", F.lit(None).cast("byte").alias("least")), rounds)
    known = core.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    start = salted_lookup(core.select("node", "up"), known, ["up"], F.col("node"))
    first = rounds.written(start.select("node", F.when(F.col("_known"), F.col("up")).alias("jump"), F.when(F.col("_known"), F.col("up")).otherwise(F.col("node")).alias("root"), F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth")))

    def step(now: DataFrame) -> DataFrame:
        above = now.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        met = salted_lookup(now, above, ["jump"], F.col("node"))
        return met.select("node", F.col("next").alias("jump"), F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))

    found = rounds.doubled(first, step).select("node", "root", "depth")
    for layer in reversed(layers):
        above = found.withColumnRenamed("node", "up")
        met = salted_lookup(layer.where("up is not null").select("node", "up"), above, ["up"], F.col("node"))
        below = met.select("node", F.coalesce("root", "node").alias("root"), F.coalesce(F.col("depth") + 1, F.lit(0)).cast("long").alias("depth"))
        roots = layer.where("up is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
        found = found.union(rounds.written(below.union(roots)))
    return found


def _digest(tokens: Column) -> Column:
    """16 bytes of a digest."""
    return F.unhex(F.substring(F.sha2(F.array_join(F.transform(tokens, lambda t: t.cast("string")), ","), 256), 1, 32))


def ancestry(turns: DataFrame, node: str = "node", parent: str = "parent", prompt: str = "prompt_ids", output: str = "output_ids") -> DataFrame:
    """(node, parent, n_prompt, n_total, begin, depth, split): where each turn stands in the segment of turns that append.

    ``begin`` is the first turn of the segment, ``depth`` the turns before this one in it; ``split`` says why a turn with a
    parent begins one: ``base`` if its prompt doesn't begin with that of the parent's segment, else ``suffix``.  A parent
    that is no turn counts as none; null arrays are empty.  Only lengths and digests are shuffled.
    """
    whole = lambda c: F.coalesce(F.col(c), F.array().cast("array<long>"))
    p, o = whole(prompt), whole(output)
    rows = turns.select(F.col(node).alias("node"), F.col(parent).alias("parent"), p.alias("p"), F.size(p).alias("n_prompt"), (F.size(p) + F.size(o)).alias("n_total"), _digest(F.concat(p, o)).alias("told"))
    above = rows.select(F.col("node").alias("parent"), F.col("n_total").alias("_n"), F.col("told").alias("_told"))
    met = salted_lookup(rows.select("node", "parent", "n_prompt", "n_total", "p"), above, ["parent"], F.col("node"))
    appends = (F.col("n_prompt") >= F.col("_n")) & (_digest(F.slice("p", F.lit(1), F.col("_n"))) == F.col("_told"))
    path = scratch(turns.sparkSession, "ancestry")
    met = met.withColumn("appends", F.coalesce(appends, F.lit(False))).withColumn("parent", F.when(F.col("_n").isNotNull(), F.col("parent")))
    # where a segment begins, the digest of its prompt is kept, and the prompt too if there is a segment above to compare it with
    begins = ~F.col("appends")
    told = F.when(begins, _digest(F.col("p"))).alias("told")
    met.select("node", "parent", "n_prompt", "n_total", "appends", told, F.when(begins & F.col("parent").isNotNull(), F.col("p")).alias("p")).write.parquet(f"{path}/edges")
    edges = turns.sparkSession.read.parquet(f"{path}/edges")
    chains = chain_roots(edges.select("node", F.when(F.col("appends"), F.col("parent")).alias("up")))
    placed = edges.drop("told", "p").join(chains.withColumnsRenamed({"root": "begin"}), "node")
    # a turn that splits is compared with the prompt that its parent's segment begins with
    splits = edges.where("parent is not null and not appends")
    of = chains.select(F.col("node").alias("parent"), F.col("root").alias("_begin"))
    begun = edges.where("not appends").select(F.col("node").alias("_begin"), F.col("n_prompt").alias("_n"), F.col("told").alias("_told"))
    against = salted_lookup(salted_lookup(splits.select("node", "parent"), of, ["parent"], F.col("node")).select("node", "_begin"), begun, ["_begin"], F.col("node"))
    judged = against.join(splits.select("node", "p"), "node").select("node", F.when((F.size("p") >= F.col("_n")) & (_digest(F.slice("p", F.lit(1), F.col("_n"))) == F.col("_told")), "suffix").otherwise("base").alias("split"))
    return placed.join(judged, "node", "left").select("node", "parent", "n_prompt", "n_total", "begin", "depth", "split")


def owned_segments(turns: DataFrame, max_context_tokens: int = 0, node: str = "node", parent: str = "parent", prompt: str = "prompt_ids", output: str = "output_ids", values: str | None = None) -> DataFrame:
    """(leaf, end, begin, n_turns, n_prompt, n_tokens, split, spans): the segments that root-to-leaf paths train on.

    A path is cut where a turn doesn't append.  Its segment up to ``end`` has that turn's prompt and output as tokens, of
    which the first n_prompt are the prompt.  Segments of more than ``max_context_tokens`` (0: no limit), and those
    without a response, are left out.  Of all paths that hold a turn in a segment that stays, the one of the least
    leaf owns its loss: ``spans`` are (begin, end, node) of the outputs owned, in order, with ``values`` (a column of
    arrays) if asked for; segments that own nothing are left out.
    """
    path = scratch(turns.sparkSession, "segments")
    ancestry(turns, node, parent, prompt, output).write.parquet(path)
    rows = turns.sparkSession.read.parquet(path)
    inner = rows.where("parent is not null").select(F.col("parent").alias("node"), F.lit(True).alias("_inner")).distinct()
    under = subtree_min(rows.join(inner, "node", "left").select("node", F.col("parent").alias("up"), F.when(F.col("_inner").isNull(), F.col("node")).alias("value")))
    appends = F.col("parent").isNotNull() & F.col("split").isNull()
    cut = rows.where("split is not null").select("node", "parent").join(under, "node").groupBy(F.col("parent").alias("node")).agg(F.min("least").alias("cut"))
    # a segment has at least the tokens of each of its turns, and what a turn appends to has fewer: longer turns own nothing
    short = rows.where(F.col("n_total") <= max_context_tokens) if max_context_tokens > 0 else rows
    begun = short.where("node = begin").select("begin", F.col("n_prompt").alias("n_base"), F.col("split").alias("why"))
    # only a leaf is its own least leaf
    ends = salted_lookup(short, begun.drop("why"), ["begin"], F.col("node")).join(under, "node").join(cut, "node", "left").withColumn("first", F.least(F.when(F.col("least") == F.col("node"), F.col("node")), "cut"))
    value = F.when((F.col("n_total") > F.col("n_base")) & F.col("first").isNotNull(), F.struct(F.col("first").alias("leaf"), F.col("node").alias("end")))
    owners = subtree_min(ends.select("node", F.when(appends, F.col("parent")).alias("up"), value.alias("value"))).where("least is not null")
    owned = short.where("n_total > n_prompt").join(owners, "node")
    if values:
        owned = owned.join(turns.select(F.col(node).alias("node"), F.col(values).alias("values")), "node")
    span = F.struct(F.col("n_prompt").alias("begin"), F.col("n_total").alias("end"), "node", *(["values"] if values else []))
    spans = owned.groupBy(F.col("least.leaf").alias("leaf"), F.col("least.end").alias("node")).agg(F.array_sort(F.collect_list(span)).alias("spans"))  # one segment's turns
    told = salted_lookup(spans.join(short, "node"), begun, ["begin"], F.col("node"))
    return told.select("leaf", F.col("node").alias("end"), "begin", (F.col("depth") + 1).alias("n_turns"), F.col("n_base").alias("n_prompt"), F.col("n_total").alias("n_tokens"), F.col("why").alias("split"), "spans")


def training_rows(segments: DataFrame, turns: DataFrame, node: str = "node", prompt: str = "prompt_ids", output: str = "output_ids") -> DataFrame:
    """(leaf, end, prompt_ids, response_ids, loss_mask) and, where spans have values, response_values: zeros where nothing is learned."""
    tokens = turns.select(F.col(node).alias("end"), F.concat(F.coalesce(F.col(prompt), F.array().cast("array<long>")), F.coalesce(F.col(output), F.array().cast("array<long>"))).alias("tokens"))
    rows = segments.join(tokens, "end")
    before = lambda i: F.when(i == 0, F.col("n_prompt")).otherwise(F.get(F.col("spans"), i - 1)["end"])
    rest = F.col("n_tokens") - F.get(F.col("spans"), F.size("spans") - 1)["end"]
    filled = lambda zero, own: F.concat(F.flatten(F.transform("spans", lambda s, i: F.concat(F.array_repeat(zero, (s["begin"] - before(i)).cast("int")), own(s)))), F.array_repeat(zero, rest.cast("int")))
    mask = filled(F.lit(0), lambda s: F.array_repeat(F.lit(1), (s["end"] - s["begin"]).cast("int")))
    more = [filled(F.lit(0.0), lambda s: s["values"]).alias("response_values")] if "values" in segments.schema["spans"].dataType.elementType.names else []
    return rows.select("leaf", "end", F.slice("tokens", F.lit(1), F.col("n_prompt")).alias("prompt_ids"), F.slice("tokens", F.col("n_prompt") + 1, F.greatest(F.lit(0), F.col("n_tokens") - F.col("n_prompt"))).alias("response_ids"), mask.alias("loss_mask"), *more)
