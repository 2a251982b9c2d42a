"""Arrays to relations and back."""

import numpy as np
import pandas as pd

from voxstrata.model import Grid


def grid_of(a: np.ndarray) -> Grid:
    d, h, w = a.shape
    return Grid(w, h, d)


def field_of(spark, a, column="v", volume_id="a"):
    a = np.asarray(a)
    z, y, x = (i.ravel().astype("int32") for i in np.indices(a.shape))
    kind = "int32" if column == "label" else "float64"
    return spark.createDataFrame(pd.DataFrame({"volume_id": volume_id, "z": z, "y": y, "x": x, column: a.ravel().astype(kind)}), f"volume_id string, z int, y int, x int, {column} {'int' if column == 'label' else 'double'}")


def array_of(df, shape, column="v"):
    p = df.toPandas()
    out = np.full(shape, np.nan)
    if len(shape) == 3:
        out[p.z, p.y, p.x] = p[column]
    else:
        out[p.y, p.x] = p[column]
    assert len(p) == out.size and not np.isnan(out).any()
    return out
