"""Streams: audits that follow new files, and eras as session windows."""
