"""Folders into which files are dropped, watched as a stream: a folder is ready once its files have rested and none is still being copied.

The stream has a row for each change that was seen: (folder, file, size, digest, gone, seen). State is a folder's files, its last change and
the content that it was last ready with; a timer in event time tells that nothing changed for a while. So a folder is told once for each
content, over restarts as well, and again only if its content has become another one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that files rest before they count, ends of names of files that are still being copied, and what counts as a recording.
SETTLE = 120
PARTIAL = (".icloud", ".download", ".crdownload", ".part")
RECORDING = (".mp3", ".m4a", ".wav", ".mp4", ".mov", ".flac", ".ogg", ".webm", ".aac")
READY = "folder string, fingerprint string, files int, recordings int, ready timestamp"
_STATE = "files string, changed long, told string"


def fingerprint(files: dict[str, list]) -> str:
    """A folder's content: its files' names and digests in order; hidden files don't count."""
    told = "\n".join(f"{name}\t{digest}" for name, (_, digest) in sorted(files.items()) if not name.startswith("."))
    return hashlib.sha256(told.encode()).hexdigest()


def rested(files: dict[str, list]) -> bool:
    """Whether a folder whose files don't change any more may be taken: it holds a recording and nothing that is still being copied."""
    names = [n.lower() for n in files if not n.startswith(".")]
    return any(n.endswith(RECORDING) for n in names) and not any(n.endswith(PARTIAL) for n in files)


def changed(files: dict[str, list], row: tuple) -> bool:
    """Takes a row (file, size, digest, gone) into files; whether anything became different. A size without a digest is one as well."""
    name, size, digest, gone = row
    if gone:
        return files.pop(name, None) is not None
    new = [int(size or 0), digest if isinstance(digest, str) else str(int(size or 0))]
    if files.get(name) == new:
        return False
    files[name] = new
    return True


def ready_folders(changes: DataFrame, settle: int = SETTLE, late: str = "1 minute") -> DataFrame:
    """(folder, fingerprint, files, recordings, ready) of a stream of changes (folder string, file string, size long, digest string, gone boolean,
    seen timestamp): a row when a folder has rested `settle` seconds since its last change, holds a recording and no file that is still
    being copied, and hasn't been told with this content before. Rows of a folder that come together are taken in the order of `seen`; a
    row that repeats what is known changes nothing. A folder's state is as large as its list of files."""
    wait = settle * 1000

    def told(folder: str, files: dict, last: int) -> dict:
        names = [n for n in files if not n.startswith(".")]
        return {"folder": folder, "fingerprint": fingerprint(files), "files": len(names), "recordings": sum(n.lower().endswith(RECORDING) for n in names), "ready": pd.Timestamp(last + wait, unit="ms")}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files, last, before = ({}, -1, "") if not state.exists else (json.loads(state.get[0]), state.get[1], state.get[2])
        out = []

        def settled_by(now: int) -> None:
            nonlocal before
            if last >= 0 and now - last >= wait and rested(files) and fingerprint(files) != before:
                before = fingerprint(files)
                out.append(told(key[0], files, last))

        if state.hasTimedOut:
            settled_by(last + wait)
        else:
            rows = pd.concat(list(batches), ignore_index=True)
            rows["ms"] = rows["seen"].astype("datetime64[ms]").astype("int64")
            for row in rows.sort_values(["ms", "file"], kind="stable").itertuples():
                settled_by(row.ms)
                if changed(files, (row.file, row.size, row.digest, bool(row.gone))):
                    last = max(last, row.ms)
        state.update((json.dumps(files), last, before))
        if last >= 0 and fingerprint(files) != before and last + wait > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last + wait)
        elif not state.hasTimedOut:
            settled_by(state.getCurrentWatermarkMs())
            state.update((json.dumps(files), last, before))
        if out:
            yield pd.DataFrame(out)

    given = changes.withWatermark("seen", late).select("folder", "file", "size", "digest", "gone", "seen")
    return given.groupBy("folder").applyInPandasWithState(step, READY, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
