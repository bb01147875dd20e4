"""Errors that the engine raises."""


class GroundlineError(Exception):
    """Base of all errors here."""


class InvalidModelConfigError(GroundlineError):
    """A model, adapter or its configuration can't be used."""


class ProviderConfigError(GroundlineError):
    """A live provider failed."""


class FormatParsingError(GroundlineError):
    """A model's output can't be read as extractions."""


class PromptValidationError(GroundlineError):
    """Few-shot examples don't ground their own extractions."""


class AlignmentError(GroundlineError):
    """An extraction can't be found in its document."""


class IOFailure(GroundlineError):
    """A file can't be read or written."""
