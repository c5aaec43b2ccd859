"""Registered queries; importing this package registers all of them."""

from rallyline.plans import logs, play, stream, text, time  # noqa: F401
