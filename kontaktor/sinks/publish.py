"""Files for people: one CSV or JSON at a path, with owner-only access, and partial files on the way."""

from __future__ import annotations

import csv
import json
import os
import re
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions import fixed
from ..operators import search
from ..sources.files import table_or_empty
from .tables import discard, written

PARTIAL = ".partial"


def owner_only(path: str | Path) -> None:
    """0600 for files, 0700 for folders; where that can't be, nothing happens."""
    try:
        os.chmod(path, 0o700 if os.path.isdir(path) else 0o600)
    except OSError:
        pass


def candidates(path: str | Path) -> list[Path]:
    p = Path(path)
    return [p, *(p.with_name(f"{p.stem}-{k}{p.suffix}") for k in range(2, 21))]


def partial_path(path: str | Path) -> Path:
    p = Path(path)
    return p.with_name(f"{p.stem}{PARTIAL}{p.suffix}")


def _write(path: Path, header: list[str], rows: Iterable[tuple]) -> None:
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    owner_only(path)


def write_csv(rows: DataFrame, path: str | Path, columns: tuple[str, ...] | None = fixed.COMPANY_COLUMNS) -> Path:
    """One CSV with a byte-order mark and a header, even without rows; other columns follow the named ones. Rows stream
    through the driver a partition at a time. Where the path can't be written, path-2 to path-20 are tried."""
    header = [*(columns or ()), *(c for c in rows.columns if c not in (columns or ()))]
    ordered = rows.select(*header)
    failure: OSError | None = None
    for p in candidates(path):
        try:
            with open(p, "a"):
                pass
        except OSError as e:
            failure = e
            continue
        _write(p, header, (tuple("" if v is None else v for v in r) for r in ordered.toLocalIterator(prefetchPartitions=True)))
        return p
    raise failure or OSError(path)


def export_results(rows: DataFrame, path: str | Path) -> Path | None:
    """CSV or, by the suffix, JSON (two spaces, letters as they are); no file without rows."""
    if rows.isEmpty():
        return None
    p = Path(path)
    if p.suffix.lower() == ".json":
        with open(p, "w", encoding="utf-8") as f:
            f.write("[")
            for k, r in enumerate(rows.toLocalIterator()):
                f.write((",\n" if k else "\n") + "\n".join("  " + line for line in json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2, default=str).split("\n")))
            f.write("\n]")
        owner_only(p)
        return p
    return write_csv(rows, p, None)


def write_yield(rows: DataFrame, path: str | Path) -> Path:
    return write_csv(rows.orderBy("qord").select("query", "urls", "new", "contacts"), path, None)


def partials(path: str | Path) -> list[Path]:
    """The partial file of a path and its numbered siblings."""
    p = partial_path(path)
    name = re.compile(re.escape(p.stem) + r"(-\d+)?" + re.escape(p.suffix))
    return sorted(x for x in p.parent.glob("*") if name.fullmatch(x.name)) if p.parent.is_dir() else []


def write_partial(rows: DataFrame, path: str | Path) -> Path | None:
    """All rows so far, filters apart, as the path's partial file, written anew; a failure is reported and passed over."""
    try:
        return write_csv(rows, partial_path(path))
    except OSError as e:
        print(f"no partial file: {e}")
        return None


def count_rows(path: str | Path) -> int:
    try:
        with open(path, newline="", encoding="utf-8-sig") as f:
            return max(0, sum(1 for _ in csv.reader(f)) - 1)
    except (OSError, csv.Error):
        return 0


def remove_partials(path: str | Path, rows_written: int) -> int:
    """Partial files go only when the final run had rows."""
    gone = 0
    for p in partials(path) if rows_written else ():
        try:
            p.unlink()
            gone += 1
        except OSError:
            pass
    return gone


def insert_results(rows: DataFrame, path: str, *, key: str = "url") -> tuple[int, int]:
    """Append to the stored results at path the first row of each key that isn't there yet; how many were inserted, and how many rows weren't."""
    n = rows.count()
    fresh = written(search.new_rows(rows, table_or_empty(rows.sparkSession, path, rows.schema), key))
    inserted = fresh.count()
    if inserted:
        fresh.write.mode("append").parquet(path)
    discard(fresh)
    return inserted, n - inserted


def managed(name: str, folder: str | Path, say: Callable[[str], None] = print) -> Path:
    """A path in the managed folder: only the name's last part counts; the folder is the owner's alone. A file that is there
    already is announced, since it will be replaced."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    owner_only(folder)
    out = folder / Path(name).name
    if out.exists():
        say(f"replaces {out}")
    return out


def listed(folder: str | Path, here: str | Path = ".") -> list[Path]:
    """Encrypted files of the managed folder, then those here whose names aren't listed yet."""
    found = sorted(Path(folder).glob("*.enc"))
    names = {p.name for p in found}
    return found + sorted(p for p in Path(here).glob("*.enc") if p.name not in names)
