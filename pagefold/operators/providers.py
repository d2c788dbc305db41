"""Models outside the engine, as providers; recorded answers stand in for them in tests and where runs have to be repeated."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions import geometry


def recorded(prompts: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("docid", "page")) -> DataFrame:
    """prompts with raw, the recorded answer of their keys, or null."""
    return prompts.join(answers.select(*keys, "raw"), list(keys), "left")


@dataclass(frozen=True)
class Retry:
    """Attempts, and the first and longest wait between them, doubling."""

    attempts: int = 5
    first: float = 2.0
    longest: float = 60.0

    def call(self, f: Callable[[str], str], prompt: str, wait: Callable[[float], None] = time.sleep) -> str | None:
        pause = self.first
        for k in range(self.attempts):
            try:
                return f(prompt)
            except (ConnectionError, TimeoutError):
                if k + 1 < self.attempts:
                    wait(pause)
                    pause = min(pause * 2, self.longest)
        return None


def completed(prompts: DataFrame, client: Callable[[], Callable[[str], str]], retry: Retry = Retry()) -> DataFrame:
    """docid, page, raw: each prompt's answer, or null where all attempts failed. client() is made once a partition; as many calls run at once as there are tasks."""

    def work(batches: Iterator) -> Iterator:
        f = client()
        for b in batches:
            yield b.assign(raw=[retry.call(f, p) for p in b.prompt])[["docid", "page", "raw"]]

    return prompts.select("docid", "page", "prompt").mapInPandas(work, f"docid {prompts.schema['docid'].dataType.simpleString()}, page int, raw string")


def few_shot_messages(examples: DataFrame) -> DataFrame:
    """docid, messages: a JSON list of user and assistant turns from examples (docid, n, prompt, answer), in order of n."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    pair = F.struct("n", F.array(turn("user", "prompt"), turn("assistant", "answer")).alias("turns"))
    return examples.groupBy("docid").agg(F.to_json(F.flatten(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["turns"]))).alias("messages"))


#: What a page is asked.
PROMPT = "[Document words]\n{layout}\n\n[Task]\n{task}"


def page_prompts(layouts: DataFrame, task: str = "Extract the fields.", hints: DataFrame | None = None) -> DataFrame:
    """docid, page, prompt for a provider, from each page's layout (docid, page, layout) and its hints (docid, page, hint), if any."""
    rows = layouts if hints is None else layouts.join(hints, ["docid", "page"], "left")
    asked = F.lit(task) if hints is None else F.concat_ws("\n", F.lit(task), "hint")
    head, middle, tail = PROMPT.replace("{layout}", "\x00").replace("{task}", "\x00").split("\x00")
    return rows.select("docid", "page", F.concat(F.lit(head), "layout", F.lit(middle), asked, F.lit(tail)).alias("prompt"))


def batched_keys(types: Sequence[str], size: int = 9) -> list[list[str]]:
    """Types in batches, for models that take a schema of a few keys."""
    return [list(types[k : k + size]) for k in range(0, len(types), size)]


def embedded(pages: DataFrame, model: Callable[[], Callable], batch: int = 16) -> DataFrame:
    """docid, embedding of each document's first page (docid, page, content), by its length; model() is made once a worker and maps a batch of contents to vectors. Pages whose batch fails have no row."""

    def work(batches: Iterator) -> Iterator:
        f = model()
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                try:
                    yield part[["docid"]].assign(embedding=[list(map(float, x)) for x in f(list(part.content))])
                except (ValueError, RuntimeError):
                    continue

    first = pages.withColumn("n", F.row_number().over(W.partitionBy("docid").orderBy("page"))).where("n = 1")
    raw = first.select("docid", "content").mapInPandas(work, f"docid {pages.schema['docid'].dataType.simpleString()}, embedding array<double>")
    return raw.withColumn("embedding", geometry.normalised(F.col("embedding")))


def best_program(attempts: DataFrame, target: float = 0.8) -> DataFrame:
    """cluster, program, recall, n: of each cluster's tries in order (cluster, try, program, recall), the best up to the first that reaches the target; the latest of equals."""
    done = F.coalesce(F.max(F.col("recall") >= target).over(W.partitionBy("cluster").orderBy("try").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    run = attempts.withColumn("done", done).where(~F.col("done"))
    best = run.groupBy("cluster").agg(F.max(F.struct("recall", "try", "program")).alias("x"), F.count("*").alias("n"))
    return best.select("cluster", "x.program", "x.recall", "n")


def row_offsets(batches: DataFrame) -> DataFrame:
    """batches (docid, ord, n_items) with first: how many items the document's earlier batches hold, so that row ids run on."""
    before = W.partitionBy("docid").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return batches.withColumn("first", F.coalesce(F.sum("n_items").over(before), F.lit(0)))
