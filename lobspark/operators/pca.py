"""First principal component of the stocks' order-flow imbalances in each cross-section.

Means, deviations and covariances are windows over the section, so the order-flow columns are computed once; the 3 x 3
eigenproblem is solved in a vectorised function, once for each section of a batch (rows of a section follow each other);
projections are Columns again. Python gets six numbers a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import PCA_MIN_STOCKS
from ..functions.nulls import total
from ..functions.windows import section_window

INPUTS = ("OFI_1", "OFI", "OFI_10")
OUTPUTS = ("OFI_PC1", "OFI_Residual", "OFI_PC1_Var")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("l0", "l1", "l2", "share")]))
def _leading(c00: pd.Series, c01: pd.Series, c02: pd.Series, c11: pd.Series, c12: pd.Series, c22: pd.Series) -> pd.DataFrame:
    """The leading eigenvector and its share; nulls for rows without figures."""
    rows = np.column_stack([c00, c01, c02, c11, c12, c22]).astype(float)
    head = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)][: len(rows)])
    one = np.nan_to_num(rows[head])
    values, vectors = np.linalg.eigh(one[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    v = vectors[:, :, -1] * np.where(vectors[:, 1, -1] < 0, -1.0, 1.0)[:, None]
    share = np.maximum(values[:, -1], 0) / np.maximum(values.sum(axis=1), 1e-12)
    out = np.repeat(np.column_stack([v, share]), np.diff(np.r_[head, len(rows)]), axis=0)
    out[np.isnan(rows).any(axis=1)] = np.nan
    return pd.DataFrame(out, columns=["l0", "l1", "l2", "share"])


def add_pca(df: DataFrame) -> DataFrame:
    """df (with INPUTS) with OUTPUTS; null in rows that lack an input and in sections of fewer than 20 complete rows."""
    whole = [F.col(x).isNotNull() for x in INPUTS]
    complete = whole[0] & whole[1] & whole[2]
    x = [F.when(complete, F.col(c)) for c in INPUTS]
    w = section_window()
    stats = {"__n": F.count(x[0]).over(w)}
    for i in range(3):
        stats |= {f"__m{i}": F.avg(x[i]).over(w), f"__s{i}": F.stddev_pop(x[i]).over(w)}
        stats |= {f"__c{i}{j}": F.covar_pop(x[i], x[j]).over(w) for j in range(i, 3)}
    out = df.withColumns(stats)
    enough = F.col("__n") >= PCA_MIN_STOCKS
    out = out.withColumns({f"__s{i}": F.when(F.col(f"__s{i}") < 1e-10, F.lit(1.0)).otherwise(F.col(f"__s{i}")) for i in range(3)})
    scaled = [F.when(enough, F.col(f"__c{i}{j}") * F.col("__n") / (F.col("__n") - 1) / (F.col(f"__s{i}") * F.col(f"__s{j}"))) for i in range(3) for j in range(i, 3)]
    out = out.withColumn("__e", _leading(*scaled))
    z = [F.when(enough, (x[i] - F.col(f"__m{i}")) / F.col(f"__s{i}")) for i in range(3)]
    out = out.withColumn("OFI_PC1", total([a * F.col(f"__e.l{i}") for i, a in enumerate(z)]))
    rest = [a - F.col("OFI_PC1") * F.col(f"__e.l{i}") for i, a in enumerate(z)]
    out = out.withColumns({"OFI_Residual": F.sqrt(total([r * r for r in rest])), "OFI_PC1_Var": F.when(complete & enough, F.col("__e.share"))})
    return out.select(*df.columns, *OUTPUTS)
