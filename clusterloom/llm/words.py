"""Words of UTF-8 texts, on bytes: both word definitions cut only at ASCII characters."""

from __future__ import annotations

#: A-Z to a-z, all other bytes unchanged.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER_AZ, and every ASCII byte but digits and letters becomes a space.
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER_AZ)


def split_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of anything but the space and the controls 9 to 13."""
    return text.translate(LOWER_AZ).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII digits and letters and all non-ASCII characters."""
    return text.translate(ALNUM).split() if text else []


def trim() -> None:
    """Give freed memory back to the system: idle Python workers of one stage stay alive beside those of the next."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        return
