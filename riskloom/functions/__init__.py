"""Part of riskloom; see the package README."""
