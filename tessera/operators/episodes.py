"""Episodes of several model calls: token spans, training rows, assembled trajectories and turn boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def output_spans(calls: DataFrame, episode: str, turn: str, prompt: str, completion: str) -> DataFrame:
    """(episode, turn, start, length): where each call's completion lies in the episode's tokens; empty ones have no span."""
    n = F.size(completion)
    return calls.where(n > 0).select(episode, turn, F.size(prompt).alias("start"), n.alias("length"))


def training_rows(calls: DataFrame, episode: str, turn: str, prompt: str, completion: str, logprobs: str, reward: str, binary: bool = False) -> DataFrame:
    """(episode, tokens, mask, logprobs, reward): one row for each episode of two tokens or more.

    The tokens are the last call's prompt and completion.  Mask and log-probabilities are for predicted
    positions: a call's lie from its prompt's length - 1 on, later calls over earlier ones; others are 0.
    """
    last = calls.groupBy(episode).agg(F.max_by(F.concat(prompt, completion), turn).alias("tokens"), F.max_by(reward, turn).alias("reward")).where(F.size("tokens") >= 2)
    put = calls.select(episode, turn, F.size(prompt).alias("_n"), F.posexplode(logprobs).alias("_i", "_lp")).select(episode, turn, (F.greatest(F.col("_n") - 1, F.lit(0)) + F.col("_i")).alias("pos"), "_lp")
    held = put.groupBy(episode, "pos").agg(F.max_by("_lp", turn).alias("lp"))
    spread = held.groupBy(episode).agg(F.map_from_entries(F.collect_list(F.struct("pos", "lp"))).alias("at"))  # as many entries as the episode has tokens
    places = F.sequence(F.lit(0), F.size("tokens") - 2)
    value = F.when(F.col("reward") > 0, 1.0).otherwise(0.0) if binary else F.col("reward")
    return last.join(spread, episode, "left").select(
        episode,
        "tokens",
        F.transform(places, lambda p: F.coalesce(F.map_contains_key("at", p), F.lit(False)).cast("int")).alias("mask"),
        F.transform(places, lambda p: F.coalesce(F.try_element_at("at", p), F.lit(0.0))).alias("logprobs"),
        value.alias("reward"),
    )


def assemble_calls(calls: DataFrame, episode: str, turn: str, prompt: str, completion: str, trim: int = 0) -> DataFrame:
    """Each call with its ``gap`` (prompt tokens that no earlier call held) and whether it ``extends`` them.

    A call extends the one before if its prompt is longer and begins with that call's prompt and
    completion, all but up to ``trim`` tokens at their end.  So each call looks at its predecessor only.
    """
    by = W.partitionBy(episode).orderBy(turn)
    held = F.concat(F.lag(prompt).over(by), F.lag(completion).over(by))
    starts = lambda n: (F.size(prompt) > n) & (F.slice(prompt, F.lit(1), n) == F.slice(F.col("_held"), F.lit(1), n))
    rows = calls.withColumn("_held", held)
    whole, cut = F.size("_held"), F.greatest(F.size("_held") - trim, F.lit(0))
    kept = F.when(F.col("_held").isNull(), 0).when(starts(whole), whole).when(starts(cut), cut)
    rows = rows.withColumn("_kept", kept)
    gap = F.slice(prompt, F.col("_kept") + 1, F.greatest(F.size(prompt) - F.col("_kept"), F.lit(0)))
    return rows.withColumn("extends", F.col("_kept").isNotNull()).withColumn("gap", gap).drop("_held", "_kept")


def trajectories(assembled: DataFrame, episode: str, turn: str, completion: str) -> DataFrame:
    """(episode, tokens, mask): gaps masked, completions trained, in turn order; episodes with a call that doesn't extend are left out."""
    piece = F.struct(F.col(turn).alias("t"), F.concat("gap", completion).alias("tokens"), F.concat(F.transform("gap", lambda _: F.lit(0)), F.transform(completion, lambda _: F.lit(1))).alias("mask"))
    pieces = assembled.groupBy(episode).agg(F.array_sort(F.collect_list(piece)).alias("p"), F.bool_and("extends").alias("fine"))
    joined = lambda field: F.flatten(F.transform("p", lambda x: x[field])).alias(field)
    return pieces.where("fine").select(episode, joined("tokens"), joined("mask"))


def turn_boundaries(text: Column, prompt: Column, total: Column, tags: str) -> Column:
    """Array of (start, end) token ranges: tag places in the text, scaled to the response's tokens; empty ranges go."""
    pieces = F.transform(F.split(text, tags), F.length)
    marks = F.transform(F.regexp_extract_all(text, F.lit(f"({tags})"), F.lit(1)), F.length)
    upto = lambda xs, k: F.aggregate(F.slice(xs, F.lit(1), k), F.lit(0), lambda a, x: a + x)
    places = F.transform(marks, lambda _, k: upto(pieces, k + 1) + upto(marks, k))
    scaled = F.transform(places, lambda c: F.least(prompt + F.floor(c * (total - prompt) / F.greatest(F.length(text), F.lit(1))), total))
    edges = F.array_distinct(F.concat(F.array(prompt.cast("long")), scaled, F.array(total.cast("long"))))
    return F.when(F.size(edges) < 2, F.array(F.struct(prompt.cast("long").alias("start"), total.cast("long").alias("end")))).otherwise(
        F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    )


def align_routing(routing: Column, prompt: Column, n: Column) -> Column:
    """Routing strings for n input positions: completion-only ones are left-padded with blanks, whole ones lose their prompt's."""
    blank = F.array_repeat(F.lit(""), prompt.cast("int"))
    whole = F.transform(routing, lambda r, i: F.when(i < prompt, F.lit("")).otherwise(r))
    wrong = F.raise_error(F.concat(F.lit("routing has "), F.size(routing).cast("string"), F.lit(" entries"))).cast("array<string>")
    return F.when(F.size(routing) == n, whole).when(F.size(routing) == n - prompt, F.concat(blank, routing)).otherwise(wrong)


#: A run's segments, as JSON the payload of a run.
SEGMENTS = "array<struct<tokens array<long>, logprobs array<double>, loss_mask array<int>, raw_logprobs array<double>, routing array<string>, finish_reason string>>"


def pack_groups(groups: DataFrame, with_reference: bool = False, completion_only: bool = False) -> DataFrame:
    """Groups as ``assemble_groups`` closes them, with ``data`` (and ``ref_data``) of kept ones instead of ``payloads``, and each run's ``trainable_tokens``.

    ``data`` has an entry for each segment of each run: (run, advantage, tokens, target_tokens, weights, inf_logprobs,
    raw_inf_logprobs, prompt_len, completion_len, truncated, routing).  Tokens predict those that follow, so targets,
    weights and logprobs are shifted by one; a prompt ends at the first token under the loss mask.  Routing is lined up
    with the tokens; ``completion_only`` blanks that of the prompt.  ``ref_data`` has no routing.

    An error: a run without segments, a segment with lists of unlike lengths, with one token, or with nothing under its mask.
    """

    def entry(run: Column, s: Column) -> Column:
        n = F.size(s["tokens"]) - 1
        after = lambda xs: F.slice(xs, F.lit(2), n)
        prompt = (F.array_position(F.transform(s["loss_mask"], lambda m: m > 0), True) - 1).cast("int")
        lined = align_routing(s["routing"], prompt - 1, n)
        routing = lined if completion_only else F.when(F.size(s["routing"]) == n, s["routing"]).otherwise(lined)
        return F.struct(
            run["runs"].alias("run"), run["advantages"].alias("advantage"), F.slice(s["tokens"], F.lit(1), n).alias("tokens"), after(s["tokens"]).alias("target_tokens"), after(s["loss_mask"]).alias("weights"),
            after(s["logprobs"]).alias("inf_logprobs"), F.coalesce(after(s["raw_logprobs"]), F.array().cast("array<double>")).alias("raw_inf_logprobs"), prompt.alias("prompt_len"),
            F.size(F.filter(s["loss_mask"], lambda m: m > 0)).alias("completion_len"), F.coalesce(s["finish_reason"] == "length", F.lit(False)).alias("truncated"), F.when(s["routing"].isNotNull(), routing).alias("routing"),
        )

    def checked(run: Column, s: Column) -> Column:
        even = [F.size(s[c]) == F.size(s["tokens"]) for c in ("logprobs", "loss_mask")]
        even.append(s["raw_logprobs"].isNull() | (F.size(s["raw_logprobs"]) == F.size(s["tokens"])))
        wrong = lambda why: F.raise_error(F.concat(F.lit("run "), run["runs"].cast("string"), F.lit(f": a segment {why}")))
        fine = F.coalesce(even[0] & even[1] & even[2], F.lit(False))
        trained = F.exists(s["loss_mask"], lambda m: m > 0)
        return F.when(~fine, wrong("has lists of unlike lengths")).when(F.size(s["tokens"]) < 2, wrong("has fewer than two tokens")).when(~trained, wrong("trains no token")).otherwise(entry(run, s))

    none = F.raise_error(F.lit("a run has no segments"))
    parts = F.transform("payloads", lambda p: F.from_json(p, SEGMENTS))
    parts = F.transform(parts, lambda s: F.when(F.size(s) > 0, s).otherwise(none))
    runs = groups.withColumn("_parts", F.when(F.col("kept"), parts))
    zipped = F.arrays_zip("runs", "advantages", "_parts")
    packed = runs.withColumn("data", F.flatten(F.transform(zipped, lambda r: F.transform(r["_parts"], lambda s: checked(r, s)))))
    trained = F.transform("_parts", lambda run: F.aggregate(run, F.lit(0), lambda n, s: n + F.size(F.filter(s["loss_mask"], lambda m: m > 0))))
    packed = packed.withColumn("trainable_tokens", trained).drop("_parts", "payloads")
    if not with_reference:
        return packed
    return packed.withColumn("ref_data", F.transform("data", lambda d: F.struct(d["tokens"].alias("tokens"), d["target_tokens"].alias("target_tokens"), d["weights"].alias("loss_mask"))))


def token_advantages(tokens: DataFrame, cap: float = 5.0) -> DataFrame:
    """(sample, pos, advantage): the sample's advantage times mask times its importance weight, capped."""
    weight = F.least(F.exp(F.col("old") - F.col("inf")), F.lit(cap))
    return tokens.select("sample", "pos", (F.col("adv") * F.when(F.col("mask") > 0.5, weight).otherwise(0.0)).alias("advantage"))


def teacher_candidates(ids: Column, logprobs: Column) -> Column:
    """Array over positions of arrays of (token_id, logprob); null where a position is empty or lengths differ."""
    uneven = (F.size(ids) != F.size(logprobs)) | F.exists(F.arrays_zip(ids.alias("a"), logprobs.alias("b")), lambda z: (F.size(z["a"]) != F.size(z["b"])) | (F.size(z["a"]) < 1))
    paired = F.zip_with(ids, logprobs, lambda a, b: F.zip_with(a, b, lambda t, lp: F.struct(t.alias("token_id"), lp.alias("logprob"))))
    return F.when(~uneven, paired)


def teacher_mass(positions: Column) -> Column:
    """(entropy, least, most, slots): mean entropy of positions, their least and greatest sum of chances, number of entries."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mass = F.transform(positions, lambda p: add(F.transform(p, lambda e: F.exp(e["logprob"]))))
    entropy = F.transform(positions, lambda p: add(F.transform(p, lambda e: -F.exp(e["logprob"]) * e["logprob"])))
    return F.struct((add(entropy) / F.size(positions)).alias("entropy"), F.array_min(mass).alias("least"), F.array_max(mass).alias("most"), F.size(F.flatten(positions)).alias("slots"))
