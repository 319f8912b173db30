"""Scanned-form extraction and cheque verification over OCR tables, on Spark."""
