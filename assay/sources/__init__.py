"""The one connector of the library: the judgment service over HTTP."""
