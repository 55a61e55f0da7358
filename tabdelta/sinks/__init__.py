"""Writers of comparison results."""
