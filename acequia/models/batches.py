"""Moving batches of packed series between Arrow rows and NumPy blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

BATCH = 128


def chunks(frames: Iterator[pd.DataFrame], size: int = BATCH) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size].reset_index(drop=True)


def gathered(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Batches of ``size`` rows, the last of fewer, whatever the frames they come in."""
    held: list[pd.DataFrame] = []
    for pdf in chunks(frames, size):
        held.append(pdf)
        while sum(map(len, held)) >= size:
            whole = pd.concat(held, ignore_index=True)
            yield whole.iloc[:size]
            held = [whole.iloc[size:].reset_index(drop=True)]
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def right_aligned(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, series) block with zeros in front of the shorter series, and lengths."""
    lengths = np.array([len(s) for s in series])
    block = np.zeros((lengths.max(), len(series)))
    for i, s in enumerate(series):
        if len(s):
            block[-len(s) :, i] = s
    return block, lengths


def isolated(
    pdf: pd.DataFrame,
    work: Callable[[pd.DataFrame], pd.DataFrame],
    failed: Callable[[pd.DataFrame, str], pd.DataFrame],
) -> Iterator[pd.DataFrame]:
    """Run ``work`` on a batch; on failure on its halves, down to rows, so one bad series costs only itself."""
    try:
        yield work(pdf)
    except Exception as problem:  # noqa: BLE001 - the message becomes the error row
        if len(pdf) == 1:
            yield failed(pdf, f"{type(problem).__name__}: {problem}")
            return
        middle = len(pdf) // 2
        for half in (pdf.iloc[:middle], pdf.iloc[middle:]):
            yield from isolated(half.reset_index(drop=True), work, failed)
