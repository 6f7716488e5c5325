"""What a caller may want to tell apart when a document can't be taken; all are SessionError."""

from __future__ import annotations


class SessionError(ValueError):
    """A document or parameter that the session can't take."""


class InvalidPdf(SessionError):
    """No readable PDF: broken, empty or protected by a password."""


class PdfTooLarge(SessionError):
    """More bytes or pages than allowed."""


class NoNativeText(SessionError):
    """Pages without a text layer, such as scans; there is no OCR."""


class EmptyDocument(SessionError):
    """No fragment was left after cleaning and segmentation."""


class InvalidAuthority(SessionError):
    """A level of authority that is none of the scale's."""


# States of sources.tables.read_pdfs that end in an error, by their beginning.
STATES = {"cifrado": InvalidPdf, "ilegible": InvalidPdf, "demasiado grande": PdfTooLarge, "demasiadas páginas": PdfTooLarge, "sin texto": NoNativeText, "sin biblioteca": SessionError}


def raise_for_state(state: str, name: str = "") -> None:
    """Nothing for ``ok``, else the error that the state stands for."""
    for begin, kind in STATES.items():
        if state.startswith(begin):
            raise kind(f"{name}: {state}" if name else state)
