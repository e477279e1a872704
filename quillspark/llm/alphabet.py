"""What the tokenizer operators share: byte alphabet and character classes."""

from __future__ import annotations

import re

#: Texts of these characters alone are cut by re; others go through the tokenizers library's own steps.
#: All are unchanged by NFC, and Python's and the library's classes agree on them.
UNSAFE = re.compile("[^\x00-˿‐-‧‰-⁞]")
#: The same for texts that are put into lower case first: characters whose lower case leaves the range are out too.
UNSAFE_LOWER = re.compile(f"[^{''.join(re.escape(chr(c)) for c in range(0x300) if not UNSAFE.search(chr(c).lower()))}‐-‧‰-⁞]")
#: In that range, numbers that are not decimal digits, and Unicode white space.
OTHER_NUMBERS, SPACE = "²³¹¼½¾", r"\t-\r \x85\xa0"
LETTER, NUMBER = rf"[^\W\d_{OTHER_NUMBERS}]", rf"[\d{OTHER_NUMBERS}]"
SIGN = rf"(?:[^\w{SPACE}]|_)"
ENDING = "'(?:s|t|re|ve|m|ll|d)"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]
