"""What can go wrong with one fit. Grouped calls put the name into an error column."""


class FitError(ValueError):
    """Base of all errors of this library."""


class NoData(FitError):
    pass


class TooManyParameters(FitError):
    """The degree asks for as many parameters as there are rows, or more."""


class WrongParameterCount(FitError):
    pass


class DegenerateDomain(FitError):
    """All x are equal, so the domain can't be scaled."""


class OutOfRange(FitError):
    """x lies outside the range of the training data."""


class NoModel(FitError):
    pass


class DidNotConverge(FitError):
    pass


class Unsupported(FitError):
    """The basis family has no such operation."""
