"""Row converters: heterogeneous annotation records to the unified sample row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.functions.geometry import identity

# Names that tell a scene or a data set from a path, in the order they are tried.
SCENE_WORDS = ("rxr", "scannetpp", "scannet", "structured3d")
TASKS = {"qa": 0, "caption": 1, "grounding": 2}


def last_value(conversation: Column, who: str) -> Column:
    """The value of the speaker's last turn."""
    return F.get(F.reverse(F.filter(conversation, lambda t: t["from"] == who)), F.lit(0))["value"]


def value_at(conversation: Column, i: int) -> Column:
    return F.get(conversation, F.lit(i))["value"]


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def resolved(path: Column, root: Column) -> Column:
    """Store paths and absolute ones stay, others are joined to the root."""
    whole = path.startswith("/") | path.rlike(r"^[a-z0-9]+://")
    return F.when(whole, path).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def without_prefix(path: Column, prefix: str = "data/") -> Column:
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.char_length(path))).otherwise(path)


def first_word_in(text: Column, words=SCENE_WORDS, default: Column | None = None) -> Column:
    """The first of the words that the text holds; null (or the default) without one."""
    out = None
    for w in words:
        hit = F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(w)) if out is None else out.when(hit, F.lit(w))
    return out if default is None else out.otherwise(default)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def task_id(task: Column) -> Column:
    known = F.create_map(*[x for k, v in TASKS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, task), F.lit(0))


def rest_as_json(df: DataFrame, skip: list[str]) -> Column:
    """All columns but the skipped ones as a JSON text."""
    return F.to_json(F.struct(*[c for c in df.columns if c not in skip]))


def destringified(text: Column | str) -> Column:
    """JSON texts inside JSON texts become objects, at any depth; only objects and lists are unfolded."""

    def unfold(x):
        if isinstance(x, str):
            try:
                inner = json.loads(x)
            except ValueError:
                return x
            return unfold(inner) if isinstance(inner, (dict, list)) else x
        if isinstance(x, dict):
            return {k: unfold(v) for k, v in x.items()}
        return [unfold(v) for v in x] if isinstance(x, list) else x

    def one(t):
        found = None if t is None else unfold(t)
        return json.dumps(found, ensure_ascii=False) if isinstance(found, (dict, list)) else t

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def image_only(images: Column) -> dict[str, Column]:
    """Columns of a sample that has images and nothing else: an identity pose for each, empty cameras."""
    return {
        "image_path": images,
        "poses": F.array_repeat(identity(), F.size(images)),
        "intrinsic": identity(),
        "depth_intrinsic": identity(),
    }


def between_images(df: DataFrame, least: int = 1, most: int = 1 << 30, column: str = "image_path") -> DataFrame:
    return df.filter(F.size(column).between(least, most))


def parallel_lists(*columns: str) -> Column:
    ok = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        ok = ok & (F.size(a) == F.size(b))
    return ok


def valid_numbers(values: Column) -> Column:
    """Neither null nor empty, without NaN or infinite numbers."""
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(values) > 0) & ~odd, F.lit(False))


def valid_depth(depth: Column, label: Column, limits: dict[str, float], default: float = 0.0) -> Column:
    """Positive, finite, and under the scene kind's limit (0: no limit)."""
    far = F.lit(default)
    for name, z in limits.items():
        far = F.when(label == name, F.lit(z)).otherwise(far)
    return F.coalesce((depth > 0) & ~F.isnan(depth) & (depth < float("inf")) & ((far == 0) | (depth < far)), F.lit(False))


def to_samples(df: DataFrame, question: Column, answer: Column, scene: Column, dataset: Column, images: Column, skip: list[str]) -> DataFrame:
    """The unified sample row of converted records, with all other columns as metadata."""
    return df.select(
        question.alias("question"), answer.alias("answer"), scene.alias("scene_name"), dataset.alias("dataset_name"),
        *[c.alias(n) for n, c in image_only(images).items()], rest_as_json(df, skip).alias("metadata"),
    )


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with ``reason``): a row is rejected for the first rule it breaks."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def parsed_rows(df: DataFrame, parse: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Samples of a function from a row to a sample; rows for which it gives None, or nothing, are skipped.

    For what expressions can't say; rows come in Arrow batches, and an error in
    ``parse`` is the row's ``error`` with null fields, not the job's.  The schema
    must not name ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    sample = parse(row)
                except Exception as e:  # whatever the caller's function raises
                    out.append({"error": f"{type(e).__name__}: {e}"})
                    continue
                if sample:
                    out.append({**sample, "error": None})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    kind = T._parse_datatype_string(f"{schema}, error string")
    arrow = to_arrow_schema(kind)
    return df.mapInArrow(run, kind)


#: Converters by name: records to unified samples.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def add(convert):
        REGISTRY[name] = convert
        return convert

    return add


@register("conversations")
def from_conversations(df: DataFrame) -> DataFrame:
    """id, image(s), conversations: the last human and the last gpt turn."""
    return to_samples(df, last_value(F.col("conversations"), "human"), last_value(F.col("conversations"), "gpt"), F.lit(None).cast("string"), F.col("dataset_name"), F.col("images"), ["conversations", "images", "dataset_name"])


@register("prompted")
def from_prompts(df: DataFrame) -> DataFrame:
    """input_prompt or question, gt_answer or answer."""
    return to_samples(df, first_non_empty(F.col("input_prompt"), F.col("question")), first_non_empty(F.col("gt_answer"), F.col("answer")), F.lit(None).cast("string"), F.col("dataset_name"), F.col("images"), ["input_prompt", "question", "gt_answer", "answer", "images", "dataset_name"])


@register("options")
def from_options(df: DataFrame) -> DataFrame:
    """question with its options appended, one a line."""
    asked = F.concat_ws("\n", "question", F.array_join("options", "\n"))
    return to_samples(df, asked, F.col("answer"), F.lit(None).cast("string"), F.col("dataset_name"), F.col("images"), ["question", "options", "answer", "images", "dataset_name"])
