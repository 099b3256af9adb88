"""Where quoted cells of CSV lines end."""

from __future__ import annotations

import re

# a cell is quoted if it begins with a quote; quotes inside are doubled, and what follows the closing one belongs to it
_QUOTED_REST = rb'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_CELL = rb'(?:"' + _QUOTED_REST + rb'|[^",][^,]*+|)'
_WHOLE = re.compile(_CELL + rb"(?:," + _CELL + rb")*+")
_CLOSING = re.compile(_QUOTED_REST + rb"(?:," + _CELL + rb")*+")


def leaves_open(line: bytes, inside: bool = False) -> bool:
    """Whether a quoted cell is open at the end of a line; ``inside`` tells of its start."""
    if b'"' not in line:
        return inside
    return (_CLOSING if inside else _WHOLE).fullmatch(line) is None
