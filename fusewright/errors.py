"""Errors of the engine; every one is a FusionError."""


class FusionError(Exception):
    """Anything that stops a run."""


class SourceError(FusionError):
    """A source cannot be read at all; single bad rows never raise it."""


class CsvError(SourceError):
    """No such table of candidates, or one without a header."""


class AtsError(SourceError):
    """No such export, or none of its files holds a JSON object."""


class ResumeError(SourceError):
    """No such résumé, or one without text."""


class ProfileError(SourceError):
    """No such developer profile."""


class ConfigError(FusionError):
    """A configuration that is missing or no JSON object."""


class SinkError(FusionError):
    """Output that cannot be written."""


class NoSourceError(FusionError):
    """No source was given, or all of them failed."""
