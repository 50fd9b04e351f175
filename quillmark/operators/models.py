"""Interfaces to language models. Models are outside of this library; what stands in for them says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import GenerationPlan

#: A generator makes, once for each task, a function from (prompts, temperature, outputs for each) to lists of texts.
Generator = Callable[[], Callable[[list[str], float, int], list[list[str]]]]


def echo_generator() -> Callable[[list[str], float, int], list[list[str]]]:
    """A stand-in for a model: the first words of the prompt's last paragraph, one fewer for each further output."""

    def generate(prompts: list[str], temperature: float, n: int) -> list[list[str]]:
        last = [p.strip().split("\n")[-1].split() for p in prompts]
        return [[" ".join(w[: max(1, 12 - k - int(temperature * 10) % 3)]) for k in range(n)] for w in last]

    return generate


def generate(prompts: Column, generator: Generator, temperature: float = 0.0, n: int = 1, batch: int = 4, capture: bool = False) -> Column:
    """``n`` outputs for each prompt (array<string>). Null prompts are empty. With ``capture`` a batch that fails gives
    empty outputs instead of ending the job, one prompt at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = generator()

        def one(part: list[str]) -> list[list[str]]:
            try:
                return model(part, temperature, n)
            except RuntimeError:
                if not capture:
                    raise
                return [[""] * n] if len(part) == 1 else [x for p in part for x in one([p])]

        for got in batches:
            values = [v or "" for v in got.to_pylist()]
            yield pa.array([x for k in range(0, len(values), batch) for x in one(values[k : k + batch])], pa.list_(pa.string()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")(prompts)


def generate_outputs(samples: DataFrame, prompt: Column, generators: dict[str, Generator], plan: GenerationPlan = GenerationPlan()) -> DataFrame:
    """``samples`` with outputs: a map from each pass of the plan to its texts; ``generators`` are by stage."""
    held = samples.withColumn("_prompt", prompt)
    entries = [x for source, stage, _, temperature, n in plan.passes() for x in (F.lit(source), generate(F.col("_prompt"), generators[stage], temperature, n))]
    return held.withColumn("outputs", F.create_map(*entries)).drop("_prompt")


def predictions(samples: DataFrame, prompt: Column, generator: Generator, clean, model: str, base_model_path: str = "", adapter_path: str = "") -> DataFrame:
    """One cleaned prediction per sample (id, instruction, function, reference); a model's failure is an empty one."""
    out = clean(F.get(generate(prompt, generator, capture=True), 0))
    return samples.select("id", "instruction", "function", "reference", out.alias("prediction"), F.lit(model).alias("model"), F.lit(base_model_path).alias("base_model_path"), F.lit(adapter_path).alias("sft_adapter_path"))
