"""Own file formats in the shared folder.

Tasks write files of their own under names that no other attempt has, and return rows that name them;
only the rows of attempts that succeed are committed, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def attempt_name(prefix: str, suffix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
