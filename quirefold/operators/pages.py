"""The document pipeline over images: engines behind a protocol, crops, second readers, and the plan from files to outputs."""
from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import images as IM
from quirefold.functions import text as T

from . import evidence as E
from . import flags as FL
from . import layout as L

#: text, confidence (0 to 100), x0, y0, x1, y1
Word = tuple[str, float, int, int, int, int]
TOKEN = "pos long, text string, conf double, x0 int, y0 int, x1 int, y1 int, granularity string, width int, height int, error string"


class OcrEngine(Protocol):
    """What reads an image. crop may be None for engines that only read pages."""

    granularity: str

    def run(self, image: np.ndarray) -> list[Word]: ...

    def crop(self, image: np.ndarray) -> tuple[str, float]: ...


_makers: dict[str, Callable[[], OcrEngine]] = {}
_made: dict[str, OcrEngine] = {}


def register(name: str, make: Callable[[], OcrEngine]) -> None:
    _makers[name] = make
    _made.pop(name, None)


def engine(name: str) -> OcrEngine:
    """The engine of a name, made once a process; a name that isn't registered is an error."""
    if name not in _made:
        if name not in _makers:
            raise ValueError(f"no engine {name!r}; there are {sorted(_makers)}")
        _made[name] = _makers[name]()
    return _made[name]


def available() -> list[str]:
    return sorted(_makers)


def chosen(name: str | None, preferred: str) -> str:
    """The engine asked for, else the preferred one, else the first; an error if it isn't there."""
    if name is None:
        name = preferred if preferred in _makers else next(iter(available()), None)
    if name not in _makers:
        raise ValueError(f"no engine {name!r}; there are {available()}")
    return name


class InkEngine:
    """A stand-in for tests and dry runs: each run of inked columns between blank ones is a word, whose text is its width."""

    granularity = "word"

    def run(self, image: np.ndarray) -> list[Word]:
        light = IM.grey(image)
        ink = light <= IM.otsu(light) if light.min() < light.max() else np.zeros(light.shape, bool)
        out: list[Word] = []
        for y0, y1 in runs(ink.any(axis=1)):
            out += [(str(x1 - x0), float(100 * ink[y0:y1, x0:x1].mean()), x0, y0, x1, y1) for x0, x1 in runs(ink[y0:y1].any(axis=0))]
        return out

    def crop(self, image: np.ndarray) -> tuple[str, float]:
        words = self.run(image)
        return " ".join(w[0] for w in words), float(np.mean([w[1] for w in words])) if words else 0.0


register("ink", InkEngine)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def scanned(files: DataFrame, name: str, content: str = "content", make: Callable[[], OcrEngine] | None = None) -> DataFrame:
    """Tokens of image files as an engine reads them, in its order. A file that can't be read, or fails, is one row with an
    error and no token, so one bad page doesn't stop a run. make: builds the engine where executors don't know its name."""
    keep = [c for c in files.columns if c != content]
    kinds = dict(files.dtypes)

    def run(batches):
        if make is not None:
            register(name, make)
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = tuple(row[c] for c in keep)
                image = IM.decode(row[content])
                if image is None:
                    out.append((*own, None, None, None, None, None, None, None, None, None, None, "unreadable"))
                    continue
                size = image.shape[1], image.shape[0]
                try:
                    words = engine(name).run(image)
                except Exception as e:  # noqa: BLE001 - an engine may raise anything
                    out.append((*own, None, None, None, None, None, None, None, None, *size, f"failed: {e}"[:200]))
                    continue
                out += [(*own, k, t, c, *box, engine(name).granularity, *size, None) for k, (t, c, *box) in enumerate(words)]
                if not words:
                    out.append((*own, None, None, None, None, None, None, None, None, *size, None))
            names = [*keep, *(p.split()[0] for p in TOKEN.split(", "))]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("pos", "x0", "y0", "x1", "y1", "width", "height")})

    return files.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), TOKEN]))


def recrops(files: DataFrame, boxes: DataFrame, name: str, key: str, pad: float = 0.15, scale: int = 2, content: str = "content") -> DataFrame:
    """An engine's reading of crops: (key, pos, read, read_conf) for boxes(key, pos, x0..y1) of files(key, content), grown by
    a share of their height and enlarged. A crop that is empty has no row. Boxes of a page come to its image."""
    kinds = dict(files.dtypes)
    asked = boxes.groupBy(key).agg(F.collect_list(F.struct("pos", "x0", "y0", "x1", "y1")).alias("boxes"))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                image = IM.decode(row[content])
                for b in row["boxes"] if image is not None else ():
                    grow = int((b["y1"] - b["y0"]) * pad)
                    part = image[max(0, b["y0"] - grow) : b["y1"] + grow, max(0, b["x0"] - grow) : b["x1"] + grow]
                    if part.size:
                        out.append((row[key], b["pos"], *engine(name).crop(IM.resized(part, part.shape[0] * scale, part.shape[1] * scale))))
            yield pd.DataFrame(out, columns=[key, "pos", "read", "read_conf"])

    return files.join(asked, key).select(key, content, "boxes").mapInPandas(run, f"{key} {kinds[key]}, pos long, read string, read_conf double")


def document_pages(files: DataFrame, name: str, page: str, threshold: float = 60.0, devanagari: bool = False, repass: bool | None = None, lang: str | None = None, content: str = "content") -> DataFrame:
    """The pipeline's tokens of image files(page, content): read, flagged, the digits read again where that is the default
    or asked for (a conflict is flagged and kept as alt_text, the text stays), and put in reading order (read_pos)."""
    from .review import repass_default

    read = scanned(files.select(page, content), name, content).where("pos is not null").drop("error")
    tokens = read.withColumn("flags", FL.flag_tokens(F.col("text"), F.col("conf"), threshold, devanagari))
    again = repass if repass is not None else bool(files.sparkSession.range(1).select(repass_default(F.lit(None).cast("boolean"), F.lit(lang))).first()[0])
    if again:
        asked = tokens.where(T.has_digit(F.col("text")) & (F.col("conf") < 95))
        reads = recrops(files.select(page, content), asked.select(page, "pos", "x0", "y0", "x1", "y1"), name, page, content=content)
        met = E.digit_repass(tokens, reads, page=page).select(page, "pos", "conflict", "alt_text")
        tokens = tokens.join(met, [page, "pos"], "left")
        tokens = tokens.withColumn("flags", F.when(F.col("conflict"), F.concat("flags", F.array(F.lit("digit_conflict")))).otherwise(F.col("flags"))).drop("conflict")
    else:
        tokens = tokens.withColumn("alt_text", F.lit(None).cast("string"))
    return tokens.join(L.reading_order(tokens, page), [page, "pos"])


def line_reader(groups: DataFrame, reads: DataFrame, page: str = "doc_id") -> DataFrame:
    """Line tokens from groups(page, line, texts, confs, box) of engine tokens and a second reader's reads(page, line, read):
    its reading where that is plausible, else the engine's texts joined; the least confidence; digits that only the
    reader saw are flagged."""
    own = T.normalize(F.array_join("texts", " "))
    met = groups.join(reads, [page, "line"], "left").withColumn("engine", own)
    plain = F.trim(F.coalesce("read", F.lit("")))
    good = E.reader_plausible(plain)
    out = met.withColumns({"text": F.when(good, plain).otherwise(F.col("engine")), "conf": F.array_min("confs"), "text_source": F.when(good, "reader").otherwise("backend")})
    return out.withColumn("flags", F.when(good & E.digit_added(F.col("engine"), plain), F.array(F.lit("digit_added"))).otherwise(F.array().cast("array<string>"))).drop("engine", "read", "texts", "confs")


def sideways(image: np.ndarray, rotate: int) -> np.ndarray:
    """An image after an orientation report's quarter turn; half turns are never applied."""
    return np.rot90(image, {90: 3, 270: 1}.get(rotate, 0))


def run_report(pages: DataFrame, tokens: DataFrame, page: str) -> DataFrame:
    """(page, status, tokens, flagged) of a run over pages(page, error): ok, skipped (nothing read) or error."""
    got = tokens.groupBy(page).agg(F.count("*").alias("tokens"), F.count(F.when(F.size("flags") > 0, 1)).alias("flagged"))
    out = pages.join(got, page, "left").fillna(0, ["tokens", "flagged"])
    return out.select(page, F.when(F.col("error").isNotNull(), "error").when(F.col("tokens") == 0, "skipped").otherwise("ok").alias("status"), "tokens", "flagged")
