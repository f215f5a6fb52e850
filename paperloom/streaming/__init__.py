"""The same operators over streams of files."""
