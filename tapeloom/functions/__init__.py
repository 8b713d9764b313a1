"""Part of tapeloom; see the README."""
