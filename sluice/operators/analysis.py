"""The optional analysis of texts by a model that the caller plugs in, and the choice among PDF readers.

No provider is called here: ``call`` is any Python function ``(text, prompt, schema, model) -> str``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.truncate import PROCUREMENT, TruncationProfile, Truncator
from sluice.operators.sniff import TRANSIENT

#: Keys that a restricted schema dialect accepts (fixed values).
SCHEMA_KEYS = frozenset(["type", "format", "description", "nullable", "enum", "items", "properties", "required", "minItems", "maxItems", "anyOf", "propertyOrdering"])
RESULT = "ok boolean, model string, used_fallback boolean, input_chars bigint, data string, text string, error string, warning string"


def prompt_with_document(prompt: Column, text: Column, tag: str = "document") -> Column:
    return F.concat(prompt, F.lit(f"\n\n<{tag}>\n"), text, F.lit(f"\n</{tag}>"))


def clean_schema(schema, names: bool = False):
    """A JSON schema with only the keys of the restricted dialect; names of properties stay."""
    if isinstance(schema, list):
        return [clean_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    return {k: clean_schema(v, names=k == "properties" and not names) for k, v in schema.items() if names or k in SCHEMA_KEYS}


def _answer(raw: str):
    text = raw.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rstrip().removesuffix("```")
    return json.loads(text)


#: Environment variables that name a model's function and its models.
CALL, MODEL, STAND_IN = "SLUICE_MODEL_CALL", "SLUICE_MODEL", "SLUICE_STAND_IN"


def resolve_provider(call: str | None = None, model: str | None = None, stand_in: str | None = None) -> tuple[Callable, tuple[str, str | None]]:
    """The function to call (``module:function``) and its models: what is given, else what the environment names, else an error."""
    import importlib
    import os

    name = call or os.environ.get(CALL)
    if not name or ":" not in name:
        raise ValueError(f"no model to call: give module:function, or set {CALL}")
    module, function = name.split(":", 1)
    return getattr(importlib.import_module(module), function), (model or os.environ.get(MODEL, "default"), stand_in or os.environ.get(STAND_IN))


def analyse(df: DataFrame, text: str, prompt: str, call: Callable[[str, str, dict | None, str], str], models: tuple[str, str | None], schema: dict | None = None, budget: int = 400_000, profile: TruncationProfile = PROCUREMENT) -> DataFrame:
    """``df`` with a struct ``analysis``: the answer of the first model, or of the second where the first was busy.

    Errors of a row stay in the row. Null and blank texts are not sent. Texts over the budget are
    fitted into it, with a warning. With a schema an answer that is no JSON is an error.
    """
    primary, stand_in = models

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fit = Truncator(profile, budget)
        names = [x.split()[0] for x in RESULT.split(", ")]

        def one(t: str | None) -> tuple:
            if not t or not t.strip():
                return False, None, False, len(t or ""), None, None, "nothing to analyze: the text is empty", None
            warning = None
            if len(t) > budget:
                before, (t, *_, method, _d, _w, _p) = len(t), fit.run(t)
                warning = f"Input was reduced from {before} to {len(t)} chars via {method}."
            for turn, model in enumerate((primary, stand_in)):
                try:
                    raw = call(t, prompt, schema, model)
                except Exception as e:
                    if turn == 0 and stand_in and stand_in != primary and any(x in repr(e).lower() for x in TRANSIENT):
                        continue
                    return False, model, turn > 0, len(t), None, None, f"{type(e).__name__}: {e}", warning
                try:
                    data = json.dumps(_answer(raw))
                except ValueError as e:
                    if schema:
                        return False, model, turn > 0, len(t), None, raw, f"the model did not return usable JSON: {e}", warning
                    data = None
                return True, model, turn > 0, len(t), data, raw, None, warning
            return False, None, False, len(t), None, None, "no model was attempted", warning

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=names)

    return df.withColumn("analysis", run(text))


def choose_reader(plumber: Column, pypdf: Column, ocr: Column, least: int = 100, ocr_enabled: bool = True) -> Column:
    """``text, method`` of a PDF from its readers' texts: the first of at least ``least`` characters, else what OCR read, else none."""
    enough = lambda c: F.coalesce(F.length(c), F.lit(0)) >= least
    read = F.coalesce(ocr, F.lit("")) if ocr_enabled else F.lit("")
    method = F.when(enough(plumber), "pdfplumber").when(enough(pypdf), "pypdf").when(read != "", "ocr").otherwise("none")
    return F.struct(F.when(enough(plumber), plumber).when(enough(pypdf), pypdf).otherwise(read).alias("text"), method.alias("method"))


#: Bounds of reading a scanned file: pages, seconds for a page, seconds for turning pages into pictures.
OCR_PAGES, OCR_PAGE_SECONDS, OCR_PICTURE_SECONDS = 30, 30, 120


def ocr_text(content: bytes, pages: int = OCR_PAGES, page_seconds: int = OCR_PAGE_SECONDS, picture_seconds: int = OCR_PICTURE_SECONDS) -> str:
    """Text of a scanned file by the installed OCR (``pdf2image`` and ``pytesseract``), within bounds of pages and time; a page out of time is left out."""
    from pdf2image import convert_from_bytes
    from pytesseract import image_to_string

    out = []
    for picture in convert_from_bytes(content, last_page=pages, timeout=picture_seconds):
        try:
            out.append(image_to_string(picture, timeout=page_seconds))
        except RuntimeError:
            continue
    return "\n\n".join(t for t in out if t.strip())


def read_pdfs(files: DataFrame, least: int = 100, ocr: bool = True) -> DataFrame:
    """``path, text, method, error`` of ``binaryFile`` rows by the installed readers, then OCR; without any, a row says so in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        readers = []
        try:
            import pdfplumber

            def plumb(b):
                with pdfplumber.open(io.BytesIO(b)) as pdf:
                    return "\n\n".join(t for p in pdf.pages if (t := p.extract_text()))

            readers.append(("pdfplumber", plumb))
        except ImportError:
            pass
        try:
            from pypdf import PdfReader

            readers.append(("pypdf", lambda b: "\n\n".join(t for p in PdfReader(io.BytesIO(b)).pages if (t := p.extract_text()))))
        except ImportError:
            pass
        if ocr:
            try:
                import pdf2image  # noqa: F401
                import pytesseract  # noqa: F401

                readers.append(("ocr", ocr_text))
            except ImportError:
                pass
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"]):
                out = (path, "", "none", None if readers else "no PDF reader is installed")
                for name, read in readers:
                    try:
                        text = read(content)
                    except Exception as e:
                        out = (path, "", "none", f"{type(e).__name__}: {e}")
                        continue
                    if len(text) >= least or name == "ocr" and text:
                        out = (path, text, name, None)
                        break
                rows.append(out)
            yield pd.DataFrame(rows, columns=["path", "text", "method", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, method string, error string")
