"""Models as batch operators: a backend is any function from pages to texts.

A backend takes a pandas DataFrame (a batch of pages) and returns as many
texts, or (text, metadata) pairs, in the same order.  It runs in mapInPandas,
one object for each task, so a model or client is set up once a task.  A call
that fails is retried and then isolated: its rows get an empty text and the
error in their metadata.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import MapType, StringType, StructType

from ..functions.batches import ROWS, release
from ..functions.geometry import EDGES

ATTEMPTS, FIRST_WAIT_S, LONGEST_WAIT_S = 6, 1.0, 16.0
TRANSIENT = {408, 429, *range(500, 505), *range(520, 523), 524}
_BY_NAME = ("Timeout", "ConnectionError", "ConnectError", "ConnectorError", "OSError", "RateLimitError", "ProtocolError", "DisconnectedError", "ServiceRequestError", "ServiceResponseError")
Backend = Callable[[pd.DataFrame], Sequence]


def status(error: BaseException) -> int | None:
    code = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    return int(code) if isinstance(code, int) else None


def transient(error: BaseException) -> bool:
    """Whether a call may succeed when it is made again."""
    if isinstance(error, TimeoutError | ConnectionError):
        return True
    code = status(error)
    return code in TRANSIENT if code is not None else type(error).__name__.endswith(_BY_NAME)


def wait_seconds(error: BaseException, attempt: int, first: float = FIRST_WAIT_S, longest: float = LONGEST_WAIT_S) -> float:
    """What the error asks for, else doubling from the first wait."""
    asked = getattr(error, "retry_after", None)
    return float(asked) if asked is not None else min(first * 2 ** max(0, attempt - 1), longest)


def retry(call: Callable, attempts: int = ATTEMPTS, budget_s: float | None = None, first: float = FIRST_WAIT_S, longest: float = LONGEST_WAIT_S, sleep: Callable[[float], None] = time.sleep):
    """call(), made again after transient errors, within a number of attempts and a total time."""
    began = time.monotonic()
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            left = None if budget_s is None else budget_s - (time.monotonic() - began)
            if attempt == attempts or not transient(error) or left is not None and left <= 0:
                raise
            wait = wait_seconds(error, attempt, first, longest)
            sleep(wait if left is None else min(wait, left))
    raise ValueError("at least one attempt is needed")


def _answers(backend: Backend, batch: pd.DataFrame, errors: tuple[type[BaseException], ...], **options) -> list[tuple[str, dict]]:
    try:
        found = list(retry(lambda: backend(batch), **options))
        if len(found) != len(batch):
            raise ValueError(f"the backend gave {len(found)} texts for {len(batch)} pages")
    except errors as error:
        if len(batch) > 1:  # one by one, so that one page fails alone
            return [x for i in range(len(batch)) for x in _answers(backend, batch.iloc[i : i + 1], errors, **options)]
        return [("", {"benchmark_error_type": type(error).__name__, "benchmark_error_message": str(error)})]
    return [x if isinstance(x, tuple) else (x, {}) for x in found]


def transcribe(pages: DataFrame, make_backend: Callable[[], Backend], batch_size: int = 8, errors: tuple[type[BaseException], ...] = (Exception,), **options) -> DataFrame:
    """pages with text and ocr_metadata (map of strings); columns so called are replaced, the order in a batch stays.

    options: of retry().
    """
    kept = StructType([x for x in pages.schema if x.name not in ("text", "ocr_metadata")])
    names = list(kept.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for whole in batches:
            answers = [x for i in range(0, len(whole), batch_size) for x in _answers(backend, whole.iloc[i : i + batch_size], errors, **options)]
            out = whole[names].copy()
            out["text"] = ["" if t is None else t for t, _ in answers]
            out["ocr_metadata"] = [{str(k): str(v) for k, v in m.items()} for _, m in answers]
            yield out

    return pages.mapInPandas(run, kept.add("text", StringType()).add("ocr_metadata", MapType(StringType(), StringType())))


def not_yet_done(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The pages without a prediction in a table of earlier runs: a rerun calls the model for these only."""
    return pages.join(done.select(key).distinct(), key, "left_anti")


def detect(pages: DataFrame, make_detector: Callable[[], Callable[[pd.DataFrame], Sequence[Sequence[tuple[float, float, float, float]]]]], batch_size: int = 8) -> DataFrame:
    """pages with ``candidates``, an array of boxes for each image, from a detector of batches."""
    kept = StructType([x for x in pages.schema if x.name != "candidates"])
    names = list(kept.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for whole in batches:
            found = [boxes for i in range(0, len(whole), batch_size) for boxes in detector(whole.iloc[i : i + batch_size])]
            out = whole[names].copy()
            out["candidates"] = [[dict(zip(EDGES, map(float, b), strict=True)) for b in boxes] for boxes in found]
            yield out

    box = StructType.fromDDL("candidates array<struct<left:double,top:double,right:double,bottom:double>>")
    return pages.mapInPandas(run, StructType([*kept, *box]))


def read_blocks(pages: DataFrame, make_reader: Callable[[], Callable[[list[dict]], Sequence[str | None]]], blocks: str = "blocks", wanted: str = "wanted", batch_size: int = 32) -> DataFrame:
    """pages with contents in ``blocks``: the second step after the layout, for the blocks of the array ``wanted``.

    Blocks of some pages share a batch and go back to their pages in the same
    task, so nothing is exchanged, and the objects of these pages only are there.  The reader gets the page's columns and the
    block's fields of each request.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make_reader()
        for whole in batches:
            at = whole.schema.get_field_index(blocks)
            for start in range(0, max(whole.num_rows, 1), ROWS):
                batch = whole.slice(start, ROWS)
                rows = batch.to_pylist(maps_as_pydicts="lossy")
                asks = [(i, b["idx"]) for i, row in enumerate(rows) for b in (row[wanted] if row[wanted] is not None else [])]
                contents: dict[tuple[int, int], str | None] = {}
                for k in range(0, len(asks), batch_size):
                    part = asks[k : k + batch_size]
                    requests = [{**{c: v for c, v in rows[i].items() if c not in (blocks, wanted)}, **next(b for b in rows[i][blocks] if b["idx"] == idx)} for i, idx in part]
                    contents.update(zip(part, reader(requests), strict=True))
                made = [None if row[blocks] is None else [{**b, "content": contents.get((i, b["idx"]), b["content"])} for b in row[blocks]] for i, row in enumerate(rows)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))
        release()

    return pages.mapInArrow(run, pages.schema)
