"""Small specification languages compiled to plain values or columns: bands, ratios, metrics, table filters."""

from __future__ import annotations

import math
import re
import shlex
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default bands in Hz.
DEFAULT_BANDS = "delta:0.5-4,theta:4-7,alpha:8-12,beta:13-30,gamma:30-80"
DEFAULT_RATIOS = "theta_beta=theta/beta,alpha_theta=alpha/theta"


def alpha_bands(iaf: float, first: float = 0.5, theta: float = 6.0, alpha: float = 2.0, beta: float = 2.0, beta_max: float = 30.0, gamma_max: float = 80.0) -> list[tuple[str, float, float]]:
    """Bands around an alpha peak, each at least as high as the one before it; none without a peak."""
    if not math.isfinite(iaf) or iaf <= 0:
        return []
    edges = [first]
    for x in (iaf - theta, iaf - alpha, iaf + beta, beta_max, gamma_max):
        edges.append(max(edges[-1], x))
    return list(zip(("delta", "theta", "alpha", "beta", "gamma"), edges, edges[1:], strict=False))


def text_of(path: str) -> str | None:
    """A small file of any store, or none."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_file(at) as f:
        return f.read().decode("utf-8-sig", "replace")


def told_bands(text: str) -> list[tuple[str, float, float]]:
    """Of a file: an alpha peak (a number, or a line `aggregate_iaf_hz=`), or bands, one or more a line."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    told = next((x.partition("=")[2] for x in lines if x.lower().startswith("aggregate_iaf_hz=")), lines[0] if len(lines) == 1 else "")
    if re.fullmatch(r"\s*[0-9]+(\.[0-9]+)?\s*", told):
        return individual(float(told))
    return bands(",".join(x.strip(",") for x in lines))


def individual(iaf: float) -> list[tuple[str, float, float]]:
    out = [b for b in alpha_bands(iaf) if b[2] > b[1]]
    if not out:
        raise ValueError(f"no bands around {iaf}")
    return out


def bands(spec: str = DEFAULT_BANDS) -> list[tuple[str, float, float]]:
    """name:low-high, comma-separated; @file with such parts; iaf=peak; iaf:folder or iaf:file of bands or a peak."""
    spec = spec.strip()
    if spec.lower().startswith("iaf="):
        try:
            return individual(float(spec[4:]))
        except ValueError as e:
            raise ValueError(f"no alpha peak: {spec!r}") from e
    if spec.startswith("@") or spec.lower().startswith("iaf:"):
        path = spec[1:] if spec.startswith("@") else spec[4:].strip().rstrip("/")
        names = [path] if spec.startswith("@") else [path, f"{path}/iaf_band_spec.txt", f"{path}/iaf_summary.txt"]
        text = next((t for t in map(text_of, names) if path and t is not None), None)
        if text is None:
            raise ValueError(f"no file of bands: {spec!r}")
        return told_bands(text)
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*([^:]+):\s*([0-9.]+)\s*-\s*([0-9.]+)\s*", part)
        if not m or float(m[3]) <= float(m[2]):
            raise ValueError(f"no band: {part!r}")
        out.append((m[1].strip(), float(m[2]), float(m[3])))
    return out


def ratios(spec: str = DEFAULT_RATIOS) -> list[tuple[str, str, str]]:
    """name=numerator/denominator; a name that comes again gets a number."""
    out, seen = [], {}
    for part in spec.split(","):
        name, _, form = part.partition("=")
        top, slash, low = (form or name).partition("/")
        if not slash:
            raise ValueError(f"no ratio: {part!r}")
        name = name.strip() if form else f"{top.strip()}_{low.strip()}"
        seen[name] = seen.get(name, 0) + 1
        out.append((name if seen[name] == 1 else f"{name}_{seen[name]}", top.strip(), low.strip()))
    return out


@dataclass
class Metric:
    kind: str
    band: str = ""
    other_band: str = ""
    channel: str = ""
    other_channel: str = ""
    measure: str = ""


def metric(spec: str) -> Metric:
    """alpha:Pz, alpha/beta:Pz, band:, ratio:, asym:, coh:, msc:, imcoh:, absimag:, pac:, mvl: forms."""
    parts = [p.strip() for p in spec.split(":")]
    head = parts[0].lower()
    if head in ("asym", "asymmetry"):
        return Metric("asymmetry", parts[1], channel=parts[2], other_channel=parts[3])
    if head in ("coh", "coherence", "msc", "imcoh", "absimag"):
        measure, rest = ("imcoh" if head in ("imcoh", "absimag") else "msc"), parts[1:]
        if len(rest) == 4:
            measure, rest = ("imcoh" if rest[0].lower() in ("imcoh", "absimag") else "msc"), rest[1:]
        return Metric("coherence", rest[0], channel=rest[1], other_channel=rest[2], measure=measure)
    if head in ("pac", "pacmi", "mvl", "pacmvl"):
        return Metric("pac", parts[1], parts[2], parts[3], measure="mvl" if "mvl" in head else "mi")
    if head in ("band", "ratio"):
        parts = parts[1:]
    if "/" in parts[0] or len(parts) == 3:
        top, low = parts[0].split("/") if "/" in parts[0] else parts[:2]
        return Metric("ratio", top, low, parts[-1])
    if len(parts) != 2:
        raise ValueError(f"no metric: {spec!r}")
    return Metric("band", parts[0], channel=parts[1])


def row_filter(df: DataFrame, text: str) -> Column:
    """Words and comparisons, all of which must hold: `-x` negates, `col:part` looks in a column, `col>=1` compares, as numbers where both sides are."""
    keys = {re.sub("[^a-z0-9]", "", c.lower()): c for c in df.columns}
    anywhere = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)))
    out = F.lit(True)
    for token in shlex.split(text):
        negate = token[:1] in "-!" and len(token) > 1
        token = token[1:] if negate else token
        m = re.fullmatch(r"([^<>=!:]+)(!=|>=|<=|:|=|>|<)(.*)", token)
        column = keys.get(re.sub("[^a-z0-9]", "", m[1].lower())) if m else None
        if not column:
            test = anywhere.contains(token.lower())
        else:
            cell, op, value = F.col(column).cast("string"), m[2], m[3]
            if op == ":":
                test = F.lower(cell).contains(value.lower())
            else:
                compare = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}[op]
                test = compare(F.lower(cell), F.lit(value.lower()))
                try:
                    number = cell.try_cast("double")
                    test = F.when(number.isNotNull(), compare(number, F.lit(float(value)))).otherwise(test)
                except ValueError:
                    pass
        test = F.coalesce(test, F.lit(False))
        out = out & (~test if negate else test)
    return out
