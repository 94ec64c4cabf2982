"""Pure Column functions; nothing here triggers a job or leaves the JVM."""
