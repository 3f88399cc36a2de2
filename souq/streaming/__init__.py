"""Structured Streaming form of the intake jobs (the source handles one form
submission per request; here submissions arrive as files)."""

from souq.streaming.intake_stream import start_product_intake, start_user_intake

__all__ = ["start_product_intake", "start_user_intake"]
