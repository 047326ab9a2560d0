"""Writers. They write and pass the records on. Importing this registers them as methods of pipelines."""

from . import text  # noqa: F401
