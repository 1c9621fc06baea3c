"""Web-visibility analytics as Spark jobs over pages, links, rankings, answers and observations."""

__version__ = "0.1.0"
