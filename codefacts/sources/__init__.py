"""Readers for what a toolchain leaves on disk.

Line-oriented dumps are read as ordered line rows and parsed with column
expressions, so one large dump spreads over many tasks.
"""
