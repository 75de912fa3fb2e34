"""Token budgets of a context window as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_OUTPUT = 32_768
OUTPUT_RATIO = 0.15
PROMPT_OVERHEAD = 512
MARGIN = 512
DEFAULT_WINDOW = 262_144
DEFAULT_MAX_TOKENS = 32_768
CHUNK_RATIO = 0.8
OVERLAP_RATIO = 0.1
MERGE_WINDOW = 128_000


def output_budget(window: Column) -> Column:
    return F.least(F.lit(MAX_OUTPUT), F.floor(window * OUTPUT_RATIO)).cast("long")


def usable_input(window: Column) -> Column:
    return F.greatest(F.lit(1), window - output_budget(window) - PROMPT_OVERHEAD - MARGIN).cast("long")


def chunk_budget(window: Column, ratio: float = CHUNK_RATIO) -> Column:
    return F.greatest(F.lit(1), F.floor(usable_input(window) * ratio)).cast("long")


def overlap_budget(window: Column, ratio: float = CHUNK_RATIO, overlap: float = OVERLAP_RATIO) -> Column:
    return F.greatest(F.lit(0), F.floor(chunk_budget(window, ratio) * overlap)).cast("long")


def py_usable(window: int) -> int:
    return max(1, window - min(MAX_OUTPUT, int(window * OUTPUT_RATIO)) - PROMPT_OVERHEAD - MARGIN)


def py_chunk(window: int, ratio: float = CHUNK_RATIO) -> int:
    return max(1, int(py_usable(window) * ratio))


def effective_max_tokens(window: Column, real_input: Column, model_cap: Column) -> Column:
    """Output tokens that a request may ask for; 0 rejects it."""
    hard = window - real_input
    return F.when(hard <= 0, F.lit(0)).otherwise(F.least(F.lit(MAX_OUTPUT), model_cap, hard)).cast("long")


def capacity_fits(tokens: Column, window: Column, max_tokens: Column) -> Column:
    return tokens + PROMPT_OVERHEAD + F.least(max_tokens, output_budget(window)) <= window


def cooldown_until(hours: Column, now: Column) -> Column:
    return (now + hours * 3_600_000).cast("long")


def retry_delay_ms(initial: float, most: float, jitter: float, retry: Column, random: Column) -> Column:
    base = F.least(F.lit(initial) * F.pow(F.lit(2.0), retry - 1), F.lit(most))
    return F.least(base * (1 - jitter + 2 * jitter * random), F.lit(most))
