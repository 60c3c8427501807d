"""Evidence for diagnosis: controls, samples, prompts and calls."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def random_patterns(items: list[str], seed: int, draws: int = 8, sizes: tuple[int, int] = (2, 4)) -> list[list[str]]:
    """Control patterns: items drawn without replacement. The stream of a seeded generator can't be made on executors; the list is short."""
    r = random.Random(seed)
    pool = sorted(items)
    return [sorted(r.sample(pool, min(len(pool), r.randint(*sizes)))) for _ in range(draws)]


def split_halves(runs: list[str], seed: int) -> tuple[list[str], list[str]]:
    """Runs in shuffled halves: one to build a library, one to test it. No run is in both."""
    runs = sorted(runs)
    random.Random(seed).shuffle(runs)
    half = len(runs) // 2
    return sorted(runs[:half]), sorted(runs[half:])


def sample_cases(cases: DataFrame, per_class: int, seed: int, key: str = "case_key") -> DataFrame:
    """``per_class`` cases of each (grp, truth), by a seeded hash: the same cases on any cluster."""
    from patternlake.operators.scoring import top

    return top(cases, per_class, [F.xxhash64(key, F.lit(seed)), key], ["grp", "truth"]).drop("rank")


def random_sets(items: DataFrame, seed: int, draws: int = 8, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """(draw, items): the control patterns that ``random_patterns`` draws from the sorted items, where these stay a table of column item.

    Only their number comes to the driver, which draws places; items are numbered by ranges. No items give no sets.
    """
    from patternlake.operators.windows import position

    pool = position(items.where("item is not null").select("item").distinct(), ["item"])
    n, r = pool.count(), random.Random(seed)
    picks = [(d, p) for d in range(draws) for p in r.sample(range(n), min(n, r.randint(*sizes)))]
    chosen = F.broadcast(items.sparkSession.createDataFrame(picks, "draw int, seq int"))  # draws times the largest size
    return pool.join(chosen, "seq").groupBy("draw").agg(F.array_sort(F.collect_list("item")).alias("items"))


def draw_cases(cases: DataFrame, per_class: int, seed: int, by: str = "grp", label: str = "truth", classes: tuple[str, ...] = ("normal", "anomalous"), key: str = "case_key", balanced: bool = False) -> DataFrame:
    """``per_class`` cases of each class of each group, exactly those that a seeded generator draws from lists in the order of ``key``; pick is the place in the draw.

    One generator goes through the groups in order, and in each through ``classes``. With ``balanced`` each group has its own, seeded with ``group|seed``, and takes of every
    class as many as its smallest has. A draw depends on the lists' lengths only, so cases are numbered by ranges and none is gathered: the driver holds a count for each group and class and
    the drawn places, which are ``per_class`` for each. Classes with fewer cases give all of them; rows with a null group, and classes not named, give none. Keys are unique in a class, or its ties are in any order.
    """
    from patternlake.operators.windows import position

    known = cases.where(F.col(by).isNotNull() & F.col(label).isin(*classes))
    sizes = {(r[by], r[label]): r["count"] for r in known.groupBy(by, label).count().collect()}
    picks, r = [], random.Random(seed)
    for g in sorted({g for g, _ in sizes}):
        n = [sizes.get((g, c), 0) for c in classes]
        if balanced:
            r, most = random.Random(f"{g}|{seed}"), min(per_class, *n)
        for c, size in zip(classes, n):
            for p in r.sample(range(size), min(size, most if balanced else per_class)):
                picks.append((g, c, p, len(picks)))
    kinds = {f.name: f.dataType for f in cases.schema.fields}
    schema = T.StructType([T.StructField(by, kinds[by]), T.StructField(label, kinds[label]), T.StructField("__at", T.IntegerType()), T.StructField("pick", T.IntegerType())])
    return position(known, [by, label, key], [by, label], out="__at").join(F.broadcast(cases.sparkSession.createDataFrame(picks, schema)), [by, label, "__at"]).drop("__at")


def call(prompts: DataFrame, client: Callable[[str], str], attempts: int = 3, schema_from: str = "prompt") -> DataFrame:
    """Add reply from ``client(prompt)``, tried up to ``attempts`` times; what fails is marked as an error and can be asked again."""

    def run(frames):
        for f in frames:
            f["reply"] = [_ask(client, p, attempts) for p in f[schema_from]]
            yield f

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())]))


def _ask(client, prompt: str, attempts: int) -> str:
    last = None
    for _ in range(attempts):
        try:
            return client(prompt)
        except Exception as e:  # noqa: BLE001
            last = e
    return f"__ERROR__ {last}"


def replay(log: pd.DataFrame) -> Callable[[str], str]:
    """A client that answers from a log (prompt, reply)."""
    known = dict(zip(log["prompt"], log["reply"]))

    def client(prompt: str) -> str:
        if prompt not in known:
            raise KeyError("not in the log")
        return known[prompt]

    return client


def resume(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Calls still to make."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")
