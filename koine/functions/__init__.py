"""Column functions: everything here stays in the JVM except where a name says udf."""
