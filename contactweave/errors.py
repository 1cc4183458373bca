"""Exceptions raised before a plan is built or run."""


class ContactWeaveError(ValueError):
    """Base class of every validation error."""


class MatrixIndexError(ContactWeaveError):
    """A bin range lies outside the matrix or is empty."""


class ResolutionError(ContactWeaveError):
    """A resolution is missing, duplicated or cannot be derived."""


class NotBalancedError(ContactWeaveError):
    """A balanced value was asked of a matrix without weights."""


class GfaFormatError(ContactWeaveError):
    """An assembly graph line does not follow GFA1."""
