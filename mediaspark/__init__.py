"""mediaspark: DataFrame operators for timestamped media streams.

Streams live in tables (packets, frames, fields, scanlines, samples, cues,
delivery logs).  Every operator takes DataFrames and returns DataFrames.
"""
