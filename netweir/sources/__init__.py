"""Readers, writers and datagram decoders."""
