"""A recurrent model of what people do next, and the rules that it and the counts agree on.

Examples are human actions with the six events before them. The model is a gated recurrent network over the events' items and the times
between them. Training is data-parallel: in each step every partition computes the gradient of its own examples, the gradients are summed in a tree, and the
driver, which holds the parameters only, makes the step. All examples count in every step, so the result does not depend on their order or
partitions but for rounding. Rules come from counts of contexts that were seen, grouped by trigger and conditions; the model's
mean probability is a second bar.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routinelens.model import ACTIONABLE, NO_READING, SECOND, is_transition
from routinelens.operators import activity
from routinelens.storage import materialise

#: Events of a context, items of the vocabulary, conditions of a rule at most, bars of a rule, and what a condition must add.
WINDOW, VOCABULARY, CONDITIONS = 6, 48, 2
OCCURRENCES, CONFIDENCE, PROBABILITY, MARGIN = 5, 0.75, 0.6, 0.02
LEAST_EXAMPLES = 40
#: Edges of the times between events in seconds; then no event before, and no event here.
EDGES = (60, 300, 900, 3600, 14400, 43200, 86400)
NO_PRIOR, NO_EVENT = len(EDGES) + 1, len(EDGES) + 2
PAD, OTHER = 0, 1
#: Sizes of the network and of the training, as plain values of the method.
ITEM, TIME, HIDDEN = 10, 4, 16
STEPS, RATE, MOMENTUM, RIDGE, SEED = 120, 0.15, 0.9, 1e-4, 41
#: Gradients summed by one task of the tree, and examples that are worked on at once.
FAN, SLICE = 32, 2048
CAUSES = ("human", "device", "automation", "script")


def events(annotated: DataFrame) -> DataFrame:
    """Transitions of what can be acted on and of binary sensors: sid, us, cause, entity_id, state (lower case), item."""
    state = F.lower("state")
    rows = annotated.filter(is_transition() & F.col("domain").isin(*ACTIONABLE, "binary_sensor") & ~state.isin(*NO_READING) & F.col("cause").isin(*CAUSES))
    return rows.select("sid", "us", "cause", "entity_id", state.alias("state"), F.concat_ws("=", "entity_id", state).alias("item"))


def vocabulary(rows: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent items, then by name."""
    return [r["item"] for r in activity.vocabulary(rows, size).collect()]


def _bucket(seconds: Column) -> Column:
    out = F.lit(len(EDGES))
    for k, edge in reversed(list(enumerate(EDGES))):
        out = F.when(seconds < edge, k).otherwise(out)
    return out


def examples(rows: DataFrame, words: list[str], services: DataFrame) -> DataFrame:
    """Human actions of the vocabulary that have a service (item, service) and an event before: sid, entity_id, state, label, context.

    A context is an array of ``WINDOW`` slots, oldest first and padded on the left: item (its number), time (its bucket), entity_id, state.
    """
    number = F.create_map(*[x for k, w in enumerate(words) for x in (F.lit(w), F.lit(k + 2))]) if words else F.lit(None).cast("map<string,int>")
    held = rows.select("sid", "us", "cause", "entity_id", "state", F.col("item").alias("done"), F.struct("us", "entity_id", "state", F.coalesce(F.element_at(number, F.col("item")), F.lit(OTHER)).alias("n")).alias("item"))
    seen = activity.windows(held, WINDOW + 1)
    past = F.col("before")
    start = F.greatest(F.size(past) - WINDOW, F.lit(0))
    slot = lambda x, i: F.struct(x["n"].alias("item"), F.when(i + start == 0, NO_PRIOR).otherwise(_bucket((x["us"] - F.get(past, i + start - 1)["us"]) / SECOND)).alias("time"), x["entity_id"].alias("entity_id"), x["state"].alias("state"))
    slots = F.transform(F.slice(past, start + 1, WINDOW), slot)
    none = F.struct(F.lit(PAD).alias("item"), F.lit(NO_EVENT).alias("time"), F.lit("").alias("entity_id"), F.lit("").alias("state"))
    label = F.element_at(number, F.col("done")) - 2
    told = seen.filter((F.col("cause") == "human") & (F.size("before") > 0)).withColumn("label", label).filter("label is not null").join(services.select(F.col("item").alias("done")).distinct(), "done", "left_semi")
    return told.select("sid", "entity_id", "state", "label", F.concat(F.array_repeat(none, F.lit(WINDOW) - F.size(slots)), slots).alias("context"))


def shapes(words: int) -> dict[str, tuple[int, ...]]:
    x = ITEM + TIME
    gates = {f"{kind}{g}": (x if kind == "W" else HIDDEN, HIDDEN) for g in "zrn" for kind in "WU"} | {f"b{g}": (HIDDEN,) for g in "zrn"}
    return {"items": (words + 2, ITEM), "times": (NO_EVENT + 1, TIME), **gates, "Wo": (HIDDEN, words), "bo": (words,)}


@dataclass
class Model:
    words: list[str]
    params: np.ndarray
    losses: list[float] = field(default_factory=list)

    def parts(self) -> dict[str, np.ndarray]:
        return unpack(self.params, len(self.words))


def unpack(flat: np.ndarray, words: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(words).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def pack(parts: dict[str, np.ndarray], words: int) -> np.ndarray:
    return np.concatenate([parts[name].ravel() for name in shapes(words)])


def initial(words: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return pack({name: rng.normal(0, 1 / np.sqrt(shape[0]), shape) if len(shape) == 2 else np.zeros(shape) for name, shape in shapes(words).items()}, words)


def _side(p: dict[str, np.ndarray], kind: str) -> np.ndarray:
    """The weights of all gates side by side."""
    return np.concatenate([p[f"{kind}{g}"] for g in "zrn"], axis=-1)


def forward(p: dict[str, np.ndarray], items: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Log-probabilities of the labels, and what backward() needs of each place.

    What an item and a time add to the gates is worked out once for each of them, and looked up for every place.
    """
    h, kept, inputs, inner = np.zeros((len(items), HIDDEN)), [], _side(p, "W"), np.concatenate((p["Uz"], p["Ur"]), axis=1)
    of_item, of_time = p["items"] @ inputs[:ITEM], p["times"] @ inputs[ITEM:] + _side(p, "b")
    for t in range(items.shape[1]):
        x = of_item[items[:, t]] + of_time[times[:, t]]
        both = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + h @ inner)))
        z, r = both[:, :HIDDEN], both[:, HIDDEN:]
        n = 2 / (1 + np.exp(-2 * (x[:, 2 * HIDDEN :] + (r * h) @ p["Un"]))) - 1  # tanh
        kept.append((h, z, r, n))
        h = (1 - z) * n + z * h
    logits = h @ p["Wo"] + p["bo"]
    logits = logits - logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), [*kept, h]


def gradient(flat: np.ndarray, words: int, items: np.ndarray, times: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed loss of the examples and its gradient."""
    p = unpack(flat, words)
    log, kept = forward(p, items, times)
    g = {name: np.zeros(shape) for name, shape in shapes(words).items()}
    rows = np.arange(len(labels))
    d = np.exp(log)
    d[rows, labels] -= 1
    g["Wo"], g["bo"] = kept[-1].T @ d, d.sum(axis=0)
    dh = d @ p["Wo"].T
    kinds = NO_EVENT + 1
    seen = np.zeros((words + 2, kinds, 3 * HIDDEN))  # what flows back to the gates, summed by item and time
    flat_seen = seen.reshape(-1, 3 * HIDDEN)
    for t in range(items.shape[1] - 1, -1, -1):
        h, z, r, n = kept[t]
        dn = dh * (1 - z) * (1 - n**2)
        back = dn @ p["Un"].T
        own = np.concatenate((dh * (h - n) * z * (1 - z), back * h * r * (1 - r), dn), axis=1)
        dz, dr = own[:, :HIDDEN], own[:, HIDDEN : 2 * HIDDEN]
        g["Uz"] += h.T @ dz
        g["Ur"] += h.T @ dr
        g["Un"] += (r * h).T @ dn
        key = items[:, t] * kinds + times[:, t]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        starts = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        flat_seen[sorted_key[starts]] += np.add.reduceat(own[order], starts, axis=0)
        dh = dh * z + back * r + dz @ p["Uz"].T + dr @ p["Ur"].T
    of_item, of_time, inputs = seen.sum(axis=1), seen.sum(axis=0), _side(p, "W")
    g["items"], g["times"] = of_item @ inputs[:ITEM].T, of_time @ inputs[ITEM:].T
    into = np.concatenate((p["items"].T @ of_item, p["times"].T @ of_time))
    for k, name in enumerate("zrn"):
        at = slice(k * HIDDEN, (k + 1) * HIDDEN)
        g[f"W{name}"], g[f"b{name}"] = into[:, at], of_time[:, at].sum(axis=0)
    return float(-log[rows, labels].sum()), pack(g, words)


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items, times and labels of a batch, a slice at a time; lists are read as they lie in memory."""
    wide = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
    items, times, labels = wide(0), wide(1), batch.column(2).to_numpy().astype(np.int64)
    for at in range(0, batch.num_rows, SLICE):
        yield items[at : at + SLICE], times[at : at + SLICE], labels[at : at + SLICE]


def encoded(told: DataFrame) -> DataFrame:
    return told.select(F.col("context.item").alias("items"), F.col("context.time").alias("times"), F.col("label").cast("long").alias("label"))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, loss, gradient as bytes) summed to one."""
    n, loss, total = 0, 0.0, None
    for batch in batches:
        for k, v, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(g)
            n, loss, total = n + k, loss + v, own.copy() if total is None else total + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["n", "loss", "gradient"])


def fit(told: DataFrame, words: list[str], steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> Model | None:
    """A model of the examples, with the mean loss before each step; none if there are too few."""
    size = len(words)
    rows = materialise(encoded(told), "examples")
    if rows.count() < LEAST_EXAMPLES:
        return None
    params, speed, losses = initial(size, seed), np.zeros(len(initial(size, seed))), []
    ridge = pack({name: np.full(shape, RIDGE if name[0] in "WU" else 0.0) for name, shape in shapes(size).items()}, size)
    schema = "n long, loss double, gradient binary"
    for _ in range(steps):
        now = params

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, total = 0, 0.0, np.zeros(len(now))
            for batch in batches:
                if batch.num_rows:
                    for part in _arrays(batch):
                        v, g = gradient(now, size, *part)
                        n, loss, total = n + len(part[2]), loss + v, total + g
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["n", "loss", "gradient"])

        found, parts = rows.mapInArrow(each, schema), rows.rdd.getNumPartitions()
        while parts > FAN:  # a tree: what reaches the driver is one gradient for at most FAN tasks
            parts = -(-parts // FAN)
            found = found.repartition(parts).mapInArrow(summed, schema)
        got = found.collect()
        n = sum(r["n"] for r in got)
        losses.append(sum(r["loss"] for r in got) / n)
        total = np.sum([np.frombuffer(r["gradient"]) for r in got], axis=0) / n + ridge * params
        speed = MOMENTUM * speed - rate * total
        params = params + speed
    return Model(words, params, losses)


def probabilities(told: DataFrame, model: Model) -> DataFrame:
    """The examples with the probability that the model gives to what was done."""
    params, size = model.params, len(model.words)
    rest = [c for c in told.columns if c not in ("context", "label")]
    held = told.select(F.col("context.item").alias("items"), F.col("context.time").alias("times"), F.col("label").cast("long").alias("label"), F.struct(*rest, "label", "context").alias("row"))
    schema = held.select("row", F.lit(0.0).alias("p")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = []
                for items, times, labels in _arrays(batch):
                    log, _ = forward(unpack(params, size), items, times)
                    found.append(np.exp(log[np.arange(len(labels)), labels]))
                yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.concatenate(found))], ["row", "p"])

    return held.mapInArrow(run, schema).select("row.*", "p")


def signatures(told: DataFrame) -> DataFrame:
    """The examples with trigger (entity_id, state) and conditions; those without a trigger of the vocabulary, or on the target itself, are left out.

    The trigger is the last event. Conditions are the last states of other entities in the vocabulary before it, two at most, in order of name.
    """
    last = F.element_at("context", -1)
    earlier = F.reverse(F.slice("context", 1, WINDOW - 1))
    empty = F.array().cast("array<struct<entity_id:string,state:string>>")
    known = lambda s: s["item"] > OTHER
    add = lambda c, s: F.when((F.size(c) < CONDITIONS) & known(s) & (s["entity_id"] != last["entity_id"]) & (s["entity_id"] != F.col("entity_id")) & ~F.exists(c, lambda x: x["entity_id"] == s["entity_id"]), F.concat(c, F.array(F.struct(s["entity_id"].alias("entity_id"), s["state"].alias("state"))))).otherwise(c)
    rows = told.filter(known(last) & (last["entity_id"] != F.col("entity_id")))
    return rows.withColumn("trigger", F.struct(last["entity_id"].alias("entity_id"), last["state"].alias("state"))).withColumn("conditions", F.array_sort(F.aggregate(earlier, empty, add)))


def rules(signed: DataFrame, occurrences: int = OCCURRENCES, confidence: float = CONFIDENCE, probability: float = PROBABILITY) -> DataFrame:
    """From rows of signatures() with p: trigger, conditions, entity_id, state, occurrences, opportunities, confidence, model_confidence.

    Per trigger and conditions the most frequent action, of equal ones the first by name, over all bars. A rule goes if a kept one of
    the same trigger and action has some of its conditions only and is hardly less confident.
    """
    each = signed.groupBy("trigger", "conditions", "entity_id", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"))
    top = F.min(F.struct((-F.col("n")).alias("few"), "entity_id", "state", "n", "p")).alias("top")
    best = each.groupBy("trigger", "conditions").agg(top, F.sum("n").alias("opportunities")).select("trigger", "conditions", "top.entity_id", "top.state", F.col("top.n").alias("occurrences"), "opportunities", (F.col("top.n") / F.col("opportunities")).alias("confidence"), F.col("top.p").alias("model_confidence"))
    good = materialise(best.filter((F.col("occurrences") >= occurrences) & (F.col("confidence") >= confidence) & (F.col("model_confidence") >= probability)), "sequence-rules")
    head = ["trigger", "entity_id", "state"]
    kept = good.filter(F.size("conditions") == 0)
    for n in range(1, CONDITIONS + 1):
        here = good.filter(F.size("conditions") == n)
        simple = kept.select(*head, F.col("conditions").alias("some"), F.col("confidence").alias("simple"))
        said = here.join(simple, head).filter((F.size(F.array_except("some", "conditions")) == 0) & (F.col("confidence") <= F.col("simple") + MARGIN)).select(*head, "conditions")
        kept = materialise(kept.unionByName(here.join(said.distinct(), [*head, "conditions"], "left_anti").select(*kept.columns)), "kept-rules")
    return kept


def mine(annotated: DataFrame, services: DataFrame, steps: int = STEPS, **bars: float) -> DataFrame | None:
    """rules() of a history, from events to model to rules; none if there is too little to learn from."""
    rows = events(annotated)
    words = vocabulary(rows)
    told = materialise(examples(rows, words, services), "sequence-examples")
    model = fit(told, words, steps)
    return None if model is None else rules(probabilities(signatures(told), model).drop("context"), **bars)
