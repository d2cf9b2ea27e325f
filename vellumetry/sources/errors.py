"""What loading may raise."""


class DatasetLoaderError(Exception):
    """Any failure to load a dataset."""


class UnsupportedFileTypeError(DatasetLoaderError):
    """The suffix isn't one that can be read."""


class EmptyDatasetError(DatasetLoaderError):
    """There are no rows or no columns."""


class FileValidationError(DatasetLoaderError):
    """The file is missing, too large or can't be parsed."""
