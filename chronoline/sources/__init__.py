"""Readers and writers: manifests, sidecars, sheets, EDF files, run stores."""
