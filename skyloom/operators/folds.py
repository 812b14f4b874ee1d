"""Folds over rows in order, for state that depends on earlier decisions: one pass over a sorted stream per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable[..., tuple | None]], inputs: list[str],
    outputs: str) -> DataFrame:
    """Adds output columns that a stateful step computes from each row's inputs, in order within a key.

    start() gives a fresh step for a key; step(*inputs) gives the row's outputs, or None to leave the row out. Rows are
    shuffled by key and sorted, then stream through; only one batch and one key's state are held, so the length of a
    series does not matter. Outputs are "name type, ..." as in a schema.
    """
    names = [part.split()[0] for part in outputs.split(",")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for batch in batches:
            results, kept = [], []
            key_rows = list(zip(*(batch[k] for k in keys), strict=True))
            for i, values in enumerate(zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in inputs), strict=True)):
                if key_rows[i] != key or step is None:
                    key, step = key_rows[i], start()
                out = step(*values)
                if out is not None:
                    results.append(out)
                    kept.append(i)
            found = pd.DataFrame(results, columns=names, index=batch.index[kept])
            yield pd.concat([batch.iloc[kept], found], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {outputs}")
