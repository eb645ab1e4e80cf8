"""Vector columns of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are not null as rows of doubles, and where they stand. Vectors of several lengths are an error."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.unique(column.drop_null().value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0]} and {lengths[-1]} components in one column")
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(int(valid.sum()), int(lengths[0]) if len(lengths) else 0), valid
