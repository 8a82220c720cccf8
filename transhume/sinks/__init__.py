"""Writers of exports, sidecars, converted sources and reports."""
